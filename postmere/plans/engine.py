"""Specifications compiled to DataFrames: row pages in total orders, grouped counts, vector ranking."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmere.plans.spec import ANY_OF, COUNTRIES, DAYS, SENSITIVITY, TIMES, QueryPolicy, Spec, day, instant


def pattern(text: str) -> str:
    """A LIKE pattern that holds where *text* stands literally."""
    for c in "\\%_":
        text = text.replace(c, "\\" + c)
    return f"%{text}%"


def sensitivity_rank(col: Column) -> Column:
    """Place of a sensitivity level; NULL for unknown ones, so a ceiling fails closed."""
    rank = F.when(col == SENSITIVITY[0], 0)
    for k, level in enumerate(SENSITIVITY[1:], 1):
        rank = rank.when(col == level, k)
    return rank


def importance_rank(col: Column) -> Column:
    return F.when(col == "high", 0).when(col == "medium", 1).otherwise(2)


_PRIORITY = lambda: [importance_rank(F.col("importance")).asc(), F.desc_nulls_last("time_sensitive"), F.desc_nulls_last("sent_at"), F.asc("id")]
ORDER_BY = {
    "newest": lambda: [F.desc_nulls_last("sent_at"), F.desc("id")],
    "oldest": lambda: [F.asc_nulls_last("sent_at"), F.asc("id")],
    "priority": _PRIORITY,
    "deadline": lambda: [F.asc_nulls_last("deadline"), *_PRIORITY()],
}
DIMENSIONS = {
    "month": lambda: F.date_format("sent_at", "yyyy-MM"),
    "facts.travel.origin_country": lambda: F.col("facts.travel.origin.country"),
    "facts.travel.destination_country": lambda: F.col("facts.travel.destination.country"),
    "facts.travel.start_year": lambda: F.date_format("facts.travel.start_date", "yyyy"),
}
_DATE_COLUMNS = {"deadline": "deadline", "facts.travel.start": "facts.travel.start_date", "facts.travel.end": "facts.travel.end_date"}


@dataclass(frozen=True)
class Tier:
    """A table with the columns that keyword and vector search read.

    *rows*: the table, or a function that gives it with the columns asked for (all if None), so that a page of ids doesn't
    carry the text of every row through the choice of holding rows.
    """

    rows: DataFrame | Callable[[set[str] | None], DataFrame]
    policy: QueryPolicy
    text: tuple[str, ...] = ("one_line", "action_summary")
    vector: str = "summary_embedding"
    ranked: str | None = None
    search_columns: tuple[str, ...] = ()

    def read(self, columns: set[str] | None) -> DataFrame:
        return self.rows(columns) if callable(self.rows) else self.rows


_ORDER_READS = {"newest": {"sent_at"}, "oldest": {"sent_at"}, "priority": {"importance", "time_sensitive", "sent_at"}, "deadline": {"deadline", "importance", "time_sensitive", "sent_at"}}
_NAME_READS = {"due": {"time_sensitive", "deadline"}, "organization": {"organizations"}, "max_sensitivity": {"sensitivity_level"}, "month": {"sent_at"}}


def reads(tier: Tier, spec: Spec, columns: tuple[str, ...] | None, order: str | None = None) -> set[str] | None:
    """The stored columns that a query needs for its filters, keyword, groups, order and result; None for all."""
    if columns is None:
        return None
    out = {"id", *columns, *_ORDER_READS.get(order or "", ())}
    for name in (*spec.filters, *spec.group_by):
        out |= {"facts"} if name.startswith("facts.") else _NAME_READS.get(name, {name})
    if spec.text is not None:
        out |= set(tier.text)
    return out | ({tier.vector} if spec.semantic is not None else set())


def condition(name: str, value, now: dt.datetime) -> Column:
    """One filter as a predicate with SQL's three-valued logic."""
    if name in ANY_OF:
        return F.col(name).isin(list(value) if isinstance(value, (list, tuple)) else [value])
    if name in COUNTRIES:
        codes = [c.upper() for c in (value if isinstance(value, (list, tuple)) else [value])]
        return DIMENSIONS[name]().isin(codes)
    if name == "due":
        return (F.col("time_sensitive") | F.col("deadline").isNotNull()) == F.lit(value)
    if name == "facts.travel":
        return F.col("facts.travel").isNotNull() == F.lit(value)
    if name == "organization":
        return F.exists("organizations", lambda x: x.ilike(pattern(value)))
    if name == "facts.travel.carrier":
        return F.lower("facts.travel.carrier") == value.lower()
    if name == "max_sensitivity":
        return sensitivity_rank(F.col("sensitivity_level")) <= SENSITIVITY.index(value)
    if name in TIMES or name in DAYS:
        col, tests = F.col(_DATE_COLUMNS.get(name, name)), []
        for end, bound in (("since", value.get("since")), ("until", value.get("until"))):
            if bound is not None:
                at = instant(bound, now)
                at = F.lit(day(at, end == "until")) if name in DAYS else F.timestamp_micros(F.lit(round(at.timestamp() * 1_000_000)))
                tests.append(col >= at if end == "since" else col < at)
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out
    return F.col(name) == F.lit(value)


def matching(tier: Tier, spec: Spec, now: dt.datetime, columns: tuple[str, ...] | None = None, order: str | None = None) -> DataFrame:
    """The tier's rows under a spec's filters and keyword; refused beforehand if the policy doesn't allow them. With
    *columns* the rows hold those and what the query reads."""
    tier.policy.check(spec)
    rows = tier.read(reads(tier, spec, columns, order))
    for name, value in spec.filters.items():
        rows = rows.filter(condition(name, value, now))
    if spec.text is not None:
        hit = F.lit(False)
        for c in tier.text:
            hit = hit | F.coalesce(F.col(c).ilike(pattern(spec.text)), F.lit(False))
        rows = rows.filter(hit)
    return rows


def after(order: str, sent_us: int | None, last_id: str) -> Column:
    """The rows behind a position in ``newest`` or ``oldest``: undated rows come last in both."""
    us = F.unix_micros("sent_at")
    if sent_us is None:
        return F.col("sent_at").isNull() & (F.col("id") < last_id if order == "newest" else F.col("id") > last_id)
    if order == "newest":
        return F.col("sent_at").isNull() | (us < sent_us) | ((us == sent_us) & (F.col("id") < last_id))
    return F.col("sent_at").isNull() | (us > sent_us) | ((us == sent_us) & (F.col("id") > last_id))


def check_position(order: str, position, depth: int) -> None:
    """Refuse a position that no page gave: ``(sent_us or None, id)`` for newest and oldest, else an offset below *depth*."""
    if position is None:
        return
    if order in ("newest", "oldest"):
        if not isinstance(position, (list, tuple)) or len(position) != 2 or isinstance(position[0], bool) or not (position[0] is None or isinstance(position[0], int)) or not isinstance(position[1], str):
            raise ValueError("a position of this order is a time and an id")
    elif isinstance(position, bool) or not isinstance(position, int) or not 0 <= position < depth:
        raise ValueError(f"a position of this order is an offset below {depth}")


def page(tier: Tier, spec: Spec, now: dt.datetime, position=None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A page of rows and one more that tells whether there is another; a sort with a limit keeps only so many rows
    a task. *position*: ``(sent_us, id)`` for newest and oldest, else an offset up to the policy's ceiling."""
    order = spec.order or "newest"
    check_position(order, position, tier.policy.max_offset + 1)
    rows = matching(tier, spec, now, columns, order)
    size = min(spec.limit, tier.policy.max_limit)
    if order in ("newest", "oldest"):
        if position is not None:
            rows = rows.filter(after(order, *position))
        out = rows.orderBy(*ORDER_BY[order]()).limit(size + 1)
    else:
        out = rows.orderBy(*ORDER_BY[order]()).offset(position or 0).limit(size + 1)
    return out if columns is None else out.select(*columns)


def drain(tier: Tier, spec: Spec, now: dt.datetime, columns: tuple[str, ...] = ("id", "sent_at")) -> list:
    """All pages of a query one after the other: a helper for small results, each page at most the policy's limit."""
    out, position, size = [], None, min(spec.limit, tier.policy.max_limit)
    while True:
        got = page(tier, spec, now, position, columns).withColumn("_us", F.unix_micros("sent_at")).collect()
        out += got[:size]
        if len(got) <= size:
            return out
        position = (got[size - 1]["_us"], got[size - 1]["id"]) if (spec.order or "newest") in ("newest", "oldest") else len(out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL for a missing or zero vector."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(tier: Tier, spec: Spec, now: dt.datetime, offset: int = 0, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Rows by cosine distance to the spec's vector, then id, down to the policy's search depth; with ``score``. One row
    more than the limit tells that there are others, except at that depth, where the last page is cut."""
    depth = tier.policy.search_depth
    check_position("semantic", offset, depth)
    rows = matching(tier, spec, now, None if columns is None else (*columns, *((tier.ranked,) if tier.ranked else ())))
    if tier.ranked:
        rows = rows.filter(tier.ranked)
    size = min(min(spec.limit, tier.policy.max_limit) + 1, depth - offset)
    query = F.array(*[F.lit(float(x)) for x in spec.semantic])
    ranked = rows.withColumn("score", 1 - cosine_distance(F.col(tier.vector), query))
    out = ranked.orderBy(F.desc_nulls_last("score"), F.asc("id")).offset(offset).limit(size)
    return out if columns is None else out.select(*columns, "score")


def groups(tier: Tier, spec: Spec, now: dt.datetime) -> DataFrame:
    """``g1..gn, items, first_us, last_us`` by group, in the order of the dimensions with NULL last; one more row than
    the limit tells that there are others."""
    rows = matching(tier, spec, now, ("sent_at",))
    names = []
    if "organization" in spec.group_by:
        rows = rows.withColumn("_organization", F.explode_outer("organizations"))
    for k, name in enumerate(spec.group_by, 1):
        value = F.col("_organization") if name == "organization" else DIMENSIONS.get(name, lambda name=name: F.col(name))()
        rows = rows.withColumn(f"g{k}", value)
        names.append(f"g{k}")
    out = rows.groupBy(*names).agg(F.count("*").alias("items"), F.min(F.unix_micros("sent_at")).alias("first_us"), F.max(F.unix_micros("sent_at")).alias("last_us"))
    return out.orderBy(*[F.asc_nulls_last(n) for n in names]).limit(min(spec.limit, tier.policy.max_limit) + 1)


def total(tier: Tier, spec: Spec, now: dt.datetime) -> DataFrame:
    """``total``: the matching items, each once however many organizations it names."""
    return matching(tier, spec, now, ()).agg(F.count("*").alias("total"))


def shaped(rows: list, spec: Spec, policy: QueryPolicy) -> dict:
    """Collected groups as ``{groups: [{dimension: value, ..., count, first, last}], truncated}``."""
    size = min(spec.limit, policy.max_limit)
    each = [{**{name: r[f"g{k}"] for k, name in enumerate(spec.group_by, 1)}, "count": r["items"], "first_us": r["first_us"], "last_us": r["last_us"]} for r in rows[:size]]
    return {"groups": each, "truncated": len(rows) > size}
