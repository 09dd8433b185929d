"""Detection and redaction of text columns: both detectors together, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from postmere.detect import credentials, identity
from postmere.detect.spans import Span, pieces, validate
from postmere.sources.tables import ship_package

# Wording of messages with recovery codes.
RECOVERY = r"(?:recovery|backup)\s+code|one[-\s]?time\s+(?:pass|code)|two[-\s]?factor|\b2fa\b|verification\s+code"
_RECOVERY = re.compile(RECOVERY, re.I)
SPAN = "array<struct<start: int, `end`: int, kind: string, category: string>>"


def detect(text: str | None) -> dict[str, int]:
    """How often each kind occurs; phones and mail addresses don't count."""
    found = Counter(s.kind for s in identity.spans(text, redaction=False))
    for name, p in credentials._COMPILED.items():
        if text and (n := len(p.findall(text))):
            found[name] += n
    return dict(found)


def detect_spans(text: str | None) -> list[Span]:
    return identity.spans(text) + credentials.spans(text)


def candidates(text: str | None) -> list[str]:
    """The kinds that a message should be audited for, with ``recovery_code`` where its wording occurs."""
    return sorted(detect(text)) + ["recovery_code"] * bool(text and _RECOVERY.search(text))


def candidate_spans(text: str | None) -> list[Span]:
    if not text:
        return []
    return sorted([*detect_spans(text), *(Span(*m.span(), "recovery_code", "hint") for m in _RECOVERY.finditer(text))])


def redact_text(text: str | None, extra: Sequence[Span] = ()) -> tuple[str, list[Span], dict[str, int]]:
    """The text with ``[REDACTED:<kind>]`` in place of each match, the spans replaced, and how many matches of each kind had a part
    replaced. *extra*: spans of another detector, checked first."""
    validate(extra, len(text or ""), "extra_spans")
    found = [*detect_spans(text), *extra]
    placed = pieces(found)
    out, at = [], 0
    for s, _ in placed:
        out += [text[at : s.start], f"[REDACTED:{s.kind}]"]
        at = s.end
    return "".join([*out, (text or "")[at:]]), [s for s, _ in placed], dict(Counter(found[k].kind for k in {k for _, k in placed}))


def windows(text: str, spans: Iterable[Span], budget: int, margin: int = 200) -> list[str]:
    """What of a text is shown to an audit of *budget* characters a call: all of it if it fits, else the stretches
    around its candidates, merged where they touch and cut into pieces of the budget."""
    if len(text) <= budget:
        return [text]
    margin = min(margin, budget // 4)
    runs: list[list[int]] = []
    for s in sorted(spans):
        lo, hi = max(0, s.start - margin), min(len(text), s.end + margin)
        if runs and lo <= runs[-1][1] and max(hi, runs[-1][1]) - runs[-1][0] <= budget:
            runs[-1][1] = max(hi, runs[-1][1])
        else:
            runs.append([lo, hi])
    return [text[k : min(k + budget, b)] for a, b in runs for k in range(a, b, budget)]


def scan_version() -> str:
    """A fingerprint of everything that decides what is detected."""
    parts = (sorted(identity.PATTERNS.items()), sorted(identity.CONTEXT.items()), identity.BESIDE, sorted(credentials.RULES.items()), RECOVERY)
    return hashlib.sha1(repr(parts).encode()).hexdigest()[:12]


def counts_of(text: Column) -> Column:
    """Map of the kinds found to how often; NULL text gives an empty map."""
    ship_package(SparkSession.active())

    @F.pandas_udf("map<string,int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([detect(t) for t in texts], dtype=object)

    return run(text)


def candidates_of(text: Column) -> Column:
    ship_package(SparkSession.active())

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([candidates(t) for t in texts], dtype=object)

    return run(text)


def spans_of(text: Column) -> Column:
    """The spans of a text column; NULL text has none."""
    ship_package(SparkSession.active())

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s.start, "end": s.end, "kind": s.kind, "category": s.category} for s in sorted(detect_spans(t))] for t in texts], dtype=object)

    return run(text)


def redact(text: Column, extra: Column | None = None) -> Column:
    """Struct ``text, counts`` of :func:`redact_text`; NULL text stays NULL. *extra*: a column of spans of another detector."""
    ship_package(SparkSession.active())

    @F.pandas_udf("struct<text: string, counts: map<string,int>>")
    def run(texts: pd.Series, more: pd.Series) -> pd.DataFrame:
        done = [redact_text(t, [Span(int(x["start"]), int(x["end"]), x["kind"], x["category"]) for x in (() if m is None else m)]) if t is not None else (None, [], {}) for t, m in zip(texts, more, strict=True)]
        return pd.DataFrame({"text": pd.Series([t for t, _, _ in done], dtype=object), "counts": pd.Series([n for _, _, n in done], dtype=object)})

    return run(text, F.lit(None).cast(SPAN) if extra is None else extra)
