"""Query specifications: what a caller may ask of a tier, checked before any plan is built."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

# The closed vocabularies of the enrichment, in their order where they have one.
VOCABULARY = {
    "category": "personal newsletter promotional notification transactional bulk other".split(),
    "domain": "work job_search education banking investing bills taxes insurance health legal government shopping travel housing social entertainment subscriptions other".split(),
    "transactional_type": "receipt order_confirmation shipping invoice statement payment refund booking subscription alert none other".split(),
    "action_type": "reply pay schedule review sign submit none".split(),
    "waiting_on": "me them none".split(),
    "importance": "high medium low".split(),
    "suggested_disposition": "keep archive trash review".split(),
}
SENSITIVITY = "none low medium high".split()
ANY_OF = frozenset(VOCABULARY)
COUNTRIES = frozenset({"facts.travel.origin_country", "facts.travel.destination_country"})
FLAGS = frozenset({"requires_action", "time_sensitive", "due", "facts.travel"})
TIMES, DAYS = frozenset({"sent_at"}), frozenset({"deadline", "facts.travel.start", "facts.travel.end"})
SHORT = frozenset({"sender_domain", "account", "source", "label", "organization", "facts.travel.carrier"})
FILTERS = ANY_OF | COUNTRIES | FLAGS | TIMES | DAYS | SHORT | {"max_sensitivity"}
ORDERS = frozenset({"newest", "oldest", "priority", "deadline"})
MOST_VALUES, LONGEST, DEEPEST = 50, 200, 200
_UNIT = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def instant(bound: str, now: dt.datetime) -> dt.datetime:
    """A bound as an instant: an ISO date or time (without offset: UTC), or a duration before *now* like ``14d``."""
    bound = bound.strip()
    if m := re.fullmatch(r"(\d+)\s*([smhdw])", bound.lower()):
        return now - dt.timedelta(seconds=int(m[1]) * _UNIT[m[2]])
    at = dt.datetime.fromisoformat(bound)
    return at.replace(tzinfo=dt.UTC) if at.tzinfo is None else at.astimezone(dt.UTC)


def day(at: dt.datetime, is_end: bool) -> dt.date:
    """The UTC day of a bound on a date column; an end after midnight counts as the next day's start."""
    at = at.astimezone(dt.UTC)
    return at.date() + dt.timedelta(days=int(is_end and at.time() != dt.time()))


def _values(name: str, value) -> list:
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if not values:
        raise ValueError(f"filter {name!r} is an empty list")
    if len(values) > MOST_VALUES:
        raise ValueError(f"filter {name!r} lists {len(values)} values; at most {MOST_VALUES}")
    return values


def _check(name: str, value) -> None:
    if name in ANY_OF:
        if bad := [v for v in _values(name, value) if v not in VOCABULARY[name]]:
            raise ValueError(f"filter {name!r} knows no {bad[0]!r}")
    elif name in COUNTRIES:
        if bad := [v for v in _values(name, value) if not (isinstance(v, str) and re.fullmatch("[A-Za-z]{2}", v))]:
            raise ValueError(f"filter {name!r}: {bad[0]!r} is no two-letter country code")
    elif name in FLAGS:
        if not isinstance(value, bool):
            raise ValueError(f"filter {name!r} takes true or false")
    elif name in TIMES | DAYS:
        if not isinstance(value, dict) or set(value) - {"since", "until"}:
            raise ValueError(f"filter {name!r} takes since and until")
        for bound in value.values():
            instant(bound, dt.datetime.now(dt.UTC))
    elif name == "max_sensitivity":
        if value not in SENSITIVITY:
            raise ValueError(f"filter {name!r} knows no {value!r}")
    elif name in SHORT:
        if not isinstance(value, str) or not 1 <= len(value) <= LONGEST:
            raise ValueError(f"filter {name!r} takes 1 to {LONGEST} characters")
    else:
        raise ValueError(f"unknown filter {name!r}")


@dataclass(frozen=True, kw_only=True)
class Spec:
    """One query: filters (all must hold), keyword, vector, order, page size, groups. Invalid ones can't be made."""

    filters: dict = field(default_factory=dict)
    text: str | None = None
    semantic: tuple[float, ...] | None = None
    order: str | None = None
    limit: int = 100
    group_by: tuple[str, ...] = ()

    def __post_init__(self):
        for name, value in self.filters.items():
            _check(name, value)
        if self.text is not None and not 1 <= len(self.text) <= LONGEST:
            raise ValueError(f"text takes 1 to {LONGEST} characters")
        if self.semantic is not None and (not self.semantic or self.order):
            raise ValueError("semantic takes a vector and no order")
        if self.order is not None and self.order not in ORDERS:
            raise ValueError(f"unknown order {self.order!r}")
        if isinstance(self.limit, bool) or not isinstance(self.limit, int) or self.limit < 1:
            raise ValueError("limit is at least 1")
        if len(set(self.group_by)) != len(self.group_by):
            raise ValueError("group_by names a dimension twice")


@dataclass(frozen=True, kw_only=True)
class QueryPolicy:
    """What a tier allows; anything else is refused by name, never ignored."""

    filterable: frozenset[str]
    aggregatable: frozenset[str]
    orders: frozenset[str]
    text: bool = True
    semantic: bool = True
    max_limit: int = 100
    search_depth: int = DEEPEST
    max_offset: int = 1000

    def __post_init__(self):
        if unknown := sorted(self.filterable - FILTERS):
            raise ValueError(f"unknown filter {unknown[0]!r}")

    def check(self, spec: Spec) -> None:
        refused = [("filter", n) for n in spec.filters if n not in self.filterable]
        refused += [("dimension", n) for n in spec.group_by if n not in self.aggregatable]
        refused += [("order", spec.order)] * (spec.order is not None and spec.order not in self.orders)
        refused += [("keyword", "text")] * (spec.text is not None and not self.text)
        refused += [("search", "semantic")] * (spec.semantic is not None and not self.semantic)
        if refused:
            raise ValueError(f"{refused[0][0]} {refused[0][1]!r} is not allowed on this tier")


SANITIZED = QueryPolicy(
    filterable=FILTERS - {"due", "label"},
    aggregatable=frozenset({"domain", "sender_domain", "organization", "month", "category", "importance", "facts.travel.origin_country", "facts.travel.destination_country", "facts.travel.start_year"}),
    orders=ORDERS,
)
PRESETS = QueryPolicy(filterable=SANITIZED.filterable | {"due"}, aggregatable=SANITIZED.aggregatable | {"suggested_disposition"}, orders=ORDERS)
SENSITIVE = QueryPolicy(filterable=frozenset({"label", "account", "source", "sent_at"}), aggregatable=frozenset({"label", "month", "account"}), orders=frozenset({"newest", "oldest"}))


def clamp(limit: int | None, most: int, default: int | None = None) -> int:
    """A tool's page size: what was asked for, within 1 and *most*."""
    return max(1, min(most, default or most if limit is None else limit))


def used(spec: Spec) -> dict:
    """The filters that a query sets, by name."""
    return {n: v for n, v in spec.filters.items() if v is not None}


def schema(policy: QueryPolicy) -> dict:
    """A JSON schema of the specs that a policy allows: only its filters, orders and dimensions."""
    any_of = lambda values: {"anyOf": [{"enum": values}, {"type": "array", "items": {"enum": values}, "minItems": 1, "maxItems": MOST_VALUES}]}
    code = {"type": "string", "pattern": "^[A-Za-z]{2}$"}
    bounds = {"type": "object", "properties": {"since": {"type": "string"}, "until": {"type": "string"}}, "additionalProperties": False}

    def of(name: str) -> dict:
        if name in ANY_OF:
            return any_of(VOCABULARY[name])
        if name in COUNTRIES:
            return {"anyOf": [code, {"type": "array", "items": code, "minItems": 1, "maxItems": MOST_VALUES}]}
        if name in FLAGS:
            return {"type": "boolean"}
        if name in TIMES | DAYS:
            return bounds
        return {"enum": SENSITIVITY} if name == "max_sensitivity" else {"type": "string", "minLength": 1, "maxLength": LONGEST}

    out: dict = {"filters": {"type": "object", "properties": {n: of(n) for n in sorted(policy.filterable)}, "additionalProperties": False}}
    if policy.text:
        out["text"] = {"type": "string", "minLength": 1, "maxLength": LONGEST}
    out["order"], out["limit"] = {"enum": sorted(policy.orders)}, {"type": "integer", "minimum": 1, "maximum": policy.max_limit}
    if policy.aggregatable:
        out["group_by"] = {"type": "array", "items": {"enum": sorted(policy.aggregatable)}, "uniqueItems": True}
    return {"type": "object", "properties": out, "additionalProperties": False}
