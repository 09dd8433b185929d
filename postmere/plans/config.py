"""Configuration: tiers with their policies, and the registry of sources. Plain mappings; a YAML file is one where the parser is installed."""

from __future__ import annotations

import dataclasses
import pathlib
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from postmere.operators.projection import Policy
from postmere.operators.redaction import Redaction
from postmere.plans.spec import SENSITIVITY, QueryPolicy

BUILT_IN: dict[str, dict] = {
    "sensitive": {"kind": "source", "query": "sensitive"},
    "sanitized": {"kind": "projected", "of": "sensitive", "query": "sanitized", "projection": {}},
}
_TIER = {"kind", "of", "path", "query", "projection"}
_SOURCE = {"id", "kind", "account", "time_zone", "date_order", "enrich", "folders", "exclude_folders", "batch_size"}


def load(path: str) -> dict[str, Any]:
    """A configuration file: JSON, or YAML where ``yaml`` is installed."""
    text = pathlib.Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        import json

        return json.loads(text)
    try:
        import yaml
    except ImportError:
        raise RuntimeError("YAML files need the package yaml; JSON files don't") from None
    return yaml.safe_load(text) or {}


def merged(base: Mapping, over: Mapping) -> dict:
    """*base* overlaid key by key; lists and plain values replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _known(what: str, given: Mapping, allowed: set[str]) -> None:
    if unknown := sorted(set(given) - allowed):
        raise ValueError(f"{what} knows no {unknown[0]!r}")


@dataclasses.dataclass(frozen=True)
class TierConfig:
    """One tier: where its tables lie, from which tier it is projected, and under which policy."""

    name: str
    kind: str
    path: str | None = None
    of: str | None = None
    projection: Policy | None = None


def policy_of(given: Mapping) -> Policy:
    _known("projection", given, {f.name for f in dataclasses.fields(Policy)})
    given = dict(given)
    if "redact" in given:
        _known("redact", given["redact"], {f.name for f in dataclasses.fields(Redaction)})
        given["redact"] = Redaction(**given["redact"])
    if "fields" in given:
        given["fields"] = tuple(given["fields"])
        _known("projection fields", dict.fromkeys(given["fields"]), set(Policy().fields))
    if given.get("sensitivity_gate", "high") not in SENSITIVITY or given.get("gate_action", "redact") not in ("redact", "stub"):
        raise ValueError("projection: unknown gate")
    return Policy(**given)


def tiers(given: Mapping | None = None) -> dict[str, TierConfig]:
    """The tiers of a configuration, the built-in ones overlaid. A projected tier must name a source tier that is there, and
    two tiers may not share a path."""
    out: dict[str, TierConfig] = {}
    for name, t in merged(BUILT_IN, given or {}).items():
        _known(f"tier {name!r}", t, _TIER)
        if t.get("kind") not in ("source", "projected"):
            raise ValueError(f"tier {name!r} is neither source nor projected")
        out[name] = TierConfig(name, t["kind"], t.get("path"), t.get("of"), policy_of(t.get("projection") or {}) if t["kind"] == "projected" else None)
    for t in out.values():
        if t.kind == "projected" and (t.of not in out or out[t.of].kind != "source"):
            raise ValueError(f"tier {t.name!r} is projected of no source tier")
    paths = [t.path for t in out.values() if t.path]
    if len(set(paths)) != len(paths):
        raise ValueError("two tiers share a path")
    return out


def path_of(found: Mapping[str, TierConfig], name: str) -> str:
    """Where a tier's tables lie; a projected one without a path lies beside its source tier."""
    t = found.get(name)
    if t is None:
        raise ValueError(f"no tier {name!r}; there are {', '.join(sorted(found))}")
    if t.path:
        return t.path
    if t.kind == "projected" and found[t.of].path:
        return f"{found[t.of].path.rstrip('/')}/{name}"
    raise ValueError(f"tier {name!r} has no path")


def narrowed(policy: QueryPolicy, filterable=None, aggregatable=None, orders=None, max_limit: int | None = None) -> QueryPolicy:
    """A query policy cut to what a tier's configuration allows; it can't allow more."""
    cut = lambda have, want: have if want is None else have & frozenset(want)
    return dataclasses.replace(policy, filterable=cut(policy.filterable, filterable), aggregatable=cut(policy.aggregatable, aggregatable), orders=cut(policy.orders, orders), max_limit=min(policy.max_limit, max_limit or policy.max_limit))


@dataclasses.dataclass(frozen=True)
class Registry:
    """The declared sources. Without any declared, sources of every kind may be enriched."""

    sources: tuple[dict, ...] = ()

    @classmethod
    def of(cls, given: list[Mapping]) -> Registry:
        for s in given:
            _known(f"source {s.get('id')!r}", s, _SOURCE)
            if not s.get("id"):
                raise ValueError("a source has no id")
        ids = [s["id"] for s in given]
        if len(set(ids)) != len(ids):
            raise ValueError("a source is declared twice")
        return cls(tuple(dict(s) for s in given))

    def declares(self, source: str | None) -> bool:
        return any(s["id"] == source for s in self.sources)

    def may_enrich(self, source: str | None) -> bool:
        return not self.sources or any(s["id"] == source and s.get("enrich", True) for s in self.sources)

    def require_enrichable(self, source: str) -> None:
        if not self.may_enrich(source):
            raise ValueError(f"source {source!r} is {'not to be enriched' if self.declares(source) else 'not declared'}")

    def options(self, source: str, **call: Any) -> dict:
        """A source's settings, what the call says before what the source says."""
        own = next((s for s in self.sources if s["id"] == source), {})
        return {**own, **{k: v for k, v in call.items() if v is not None}}

    def frame(self, spark: SparkSession) -> DataFrame:
        """``source, enrichable``, for joins."""
        return spark.createDataFrame([(s["id"], bool(s.get("enrich", True))) for s in self.sources], "source string, enrichable boolean")
