"""The tools of a tier: queries, search, counts and lookups with paging cursors, the fixed presets, and the briefing.

Each tool builds plans of :mod:`postmere.plans.engine`, collects one page of a bounded size and puts it into an envelope.
"""

from __future__ import annotations

import bisect
import dataclasses
import datetime as dt
import json
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmere.operators.envelope import WITHHELD, decode_cursor, encode_cursor, flags_of, wrap
from postmere.plans import engine
from postmere.plans.served import COLUMNS
from postmere.plans.spec import DAYS, TIMES, QueryPolicy, Spec, clamp, instant

MAX_LIMIT, SEARCH_LIMIT, MAX_OFFSET = 100, 50, 1000
#: How long ago a cursor's relative bounds may have been resolved.
MAX_AGE = dt.timedelta(hours=1)
#: Columns with text of third parties, and group keys read from it.
UNTRUSTED = ("one_line", "action_summary", "organizations", "facts", "sender_domain", "thread_id")
GROUP_UNTRUSTED = ("organization", "sender_domain")
SECTIONS = ("due_soon", "action_items", "waiting_on_me")
BRIEFING_COLUMNS = ("id", "source", "sent_at", "domain", "category", "importance", "action_type", "deadline", "waiting_on", "one_line")
BRIEFING_BYTES, BRIEFING_SCAN, TOP = 24 * 1024, 1000, 20
OVERDUE, AHEAD = 7, 30


def relative(bound: str) -> bool:
    """Whether a bound is a duration before now."""
    return re.fullmatch(r"\d+\s*[smhdw]", bound.strip().lower()) is not None


def resume(spec: Spec, position, now: dt.datetime, most: int, keyset: bool) -> tuple[Spec, dict[str, str], object]:
    """The spec with its relative bounds fixed, these bounds, and the place to go on from.

    The first page resolves each relative bound; later ones take them from the cursor, which may neither widen a window nor add one:
    each must lie within :data:`MAX_AGE` before what the call's own bound gives now.
    """
    ends = {f"{n}.{e}": v[e] for n, v in spec.filters.items() if n in TIMES | DAYS for e in ("since", "until") if v.get(e) and relative(v[e])}
    if position is None:
        frozen, at = {k: instant(v, now).isoformat() for k, v in ends.items()}, None
    else:
        if not isinstance(position, dict) or set(position) != {"at", "bounds"} or not isinstance(position["bounds"], dict) or set(position["bounds"]) != set(ends):
            raise ValueError("not a cursor")
        frozen, at = position["bounds"], position["at"]
        for k, v in ends.items():
            try:
                moment = dt.datetime.fromisoformat(frozen[k])
            except (TypeError, ValueError):
                raise ValueError("not a cursor") from None
            if moment.tzinfo is None or not instant(v, now) - MAX_AGE <= moment <= instant(v, now):
                raise ValueError("not a cursor")
        if isinstance(at, list) and not keyset:
            raise ValueError("not a cursor")
    filters = {n: {e: frozen.get(f"{n}.{e}", x) for e, x in v.items()} if n in TIMES | DAYS else v for n, v in spec.filters.items()}
    if at is not None:
        engine.check_position((spec.order or "newest") if keyset else "semantic", at, most)
    return dataclasses.replace(spec, filters=filters), frozen, at


def rows_of(page: DataFrame) -> list[dict]:
    """A page's rows as plain values; its size is bounded by the plan's limit."""
    return [r.asDict(recursive=True) for r in page.collect()]


def marked(rows: list[dict], untrusted: tuple[str, ...], withhold: tuple[str, ...] = ()) -> list[dict]:
    """Rows with their flags; in flagged ones the columns of *withhold* say so instead of their text."""

    def strings(value, listed: bool, out: tuple[list, list]) -> None:
        if isinstance(value, str):
            out[listed].append(value)
        elif isinstance(value, dict):
            for v in value.values():
                strings(v, listed, out)
        elif isinstance(value, (list, tuple)):
            for v in value:
                strings(v, True, out)

    done = []
    for row in rows:
        found: tuple[list, list] = ([], [])
        for c in untrusted:
            strings(row.get(c), False, found)
        flagged = flags_of(*found)
        done.append({**row, **{c: WITHHELD for c in withhold if flagged and row.get(c) is not None}, "flags": flagged})
    return done


@dataclasses.dataclass(frozen=True)
class Server:
    """One tier as its tools see it. *embed*: text to vector, for search; *now*: the clock that relative bounds count from."""

    name: str
    tier: engine.Tier
    now: Callable[[], dt.datetime]
    embed: Callable[[str], list[float]] | None = None
    columns: tuple[str, ...] = tuple(COLUMNS)
    untrusted: tuple[str, ...] = UNTRUSTED
    search_columns: tuple[str, ...] | None = None

    def _wrap(self, tool: str, rows: list[dict], untrusted: tuple[str, ...], **more) -> dict:
        known = tuple(c for c in untrusted if any(c in r for r in rows)) or untrusted
        return wrap(marked(rows, untrusted), server=f"postmere-{self.name}", tool=tool, tier=self.name, untrusted=known, **more)

    def _page(self, tool: str, args: dict, spec: Spec, cursor: str | None, limit: int | None, policy: QueryPolicy | None = None) -> dict:
        tier = dataclasses.replace(self.tier, policy=policy or self.tier.policy)
        args = {"tier": self.name, **args}
        position = None if cursor is None else decode_cursor(cursor, tool, args)
        size = clamp(limit, tier.policy.max_limit)
        spec, bounds, at = resume(dataclasses.replace(spec, limit=size), position, self.now(), MAX_OFFSET, keyset=True)
        order = spec.order or "newest"
        got = rows_of(engine.page(tier, spec, self.now(), tuple(at) if isinstance(at, list) else at, tuple(dict.fromkeys((*self.columns, "sent_at")))).withColumn("_us", F.unix_micros("sent_at")))
        more, rows, nxt = len(got) > size, got[:size], None
        if more and order in ("newest", "oldest"):
            nxt = [rows[-1]["_us"], rows[-1]["id"]]
        elif more and (at or 0) + size < MAX_OFFSET:
            nxt = (at or 0) + size
        rows = [{c: r[c] for c in self.columns} for r in rows]
        return self._wrap(tool, rows, self.untrusted, cursor=None if nxt is None else encode_cursor(tool, args, {"at": nxt, "bounds": bounds}))

    def query(self, filters: dict | None = None, text: str | None = None, order: str | None = None, limit: int | None = None, cursor: str | None = None) -> dict:
        """Rows under filters, one page a call."""
        return self._page("query", {"filters": filters or {}, "text": text, "order": order}, Spec(filters=filters or {}, text=text, order=order), cursor, limit)

    def search(self, text: str, filters: dict | None = None, keyword: str | None = None, limit: int | None = None, cursor: str | None = None) -> dict:
        """Rows by meaning, down to the tier's search depth."""
        if self.embed is None:
            raise ValueError("this server has no embedder")
        if not 1 <= len(text) <= 2000:
            raise ValueError("a search takes 1 to 2000 characters")
        args = {"tier": self.name, "text": text, "filters": filters or {}, "keyword": keyword}
        position = None if cursor is None else decode_cursor(cursor, "search", args)
        depth, size = self.tier.policy.search_depth, clamp(limit, SEARCH_LIMIT)
        spec, bounds, at = resume(Spec(filters=filters or {}, text=keyword, limit=size), position, self.now(), depth, keyset=False)
        spec = dataclasses.replace(spec, semantic=tuple(self.embed(text)))
        columns = self.search_columns or self.columns
        got = rows_of(engine.nearest(self.tier, spec, self.now(), at or 0, columns))
        nxt = (at or 0) + size if len(got) > size and (at or 0) + size < depth else None
        return self._wrap("search", got[:size], self.untrusted, cursor=None if nxt is None else encode_cursor("search", args, {"at": nxt, "bounds": bounds}))

    def aggregate(self, group_by: list[str], filters: dict | None = None, text: str | None = None, limit: int | None = None) -> dict:
        """Counts of the matching items by group, and of all of them."""
        spec = Spec(filters=filters or {}, text=text, group_by=tuple(group_by), limit=clamp(limit, self.tier.policy.max_limit))
        shaped = engine.shaped(engine.groups(self.tier, spec, self.now()).collect(), spec, self.tier.policy)
        whole = engine.total(self.tier, dataclasses.replace(spec, group_by=()), self.now()).first()["total"]
        return self._wrap("aggregate", shaped["groups"], tuple(d for d in group_by if d in GROUP_UNTRUSTED), total=whole, truncated=shaped["truncated"])

    def get(self, id: str, tool: str = "get") -> dict:
        """One row by id: none or one."""
        got = rows_of(self.tier.read({*self.columns, "id"}).filter(F.col("id") == id).select(*self.columns).limit(1))
        return self._wrap(tool, got, self.untrusted)

    # fixed queries

    def action_items(self, limit: int | None = 50, domain: str | None = None, importance: str | None = None, cursor: str | None = None) -> dict:
        given = {k: v for k, v in (("domain", domain), ("importance", importance)) if v}
        return self._page("index_action_items", given, Spec(filters={"requires_action": True, **given}, order="priority"), cursor, limit)

    def due_soon(self, limit: int | None = 50, cursor: str | None = None) -> dict:
        return self._page("index_due_soon", {}, Spec(filters={"due": True}, order="deadline"), cursor, limit)

    def waiting_on(self, who: str = "them", limit: int | None = 50, cursor: str | None = None) -> dict:
        return self._page("index_waiting_on", {"who": who}, Spec(filters={"waiting_on": who}, order="priority"), cursor, limit)

    def by_domain(self, domain: str, limit: int | None = 50, cursor: str | None = None) -> dict:
        return self._page("index_by_domain", {"domain": domain}, Spec(filters={"domain": domain}, order="priority"), cursor, limit)

    def summary(self, id: str) -> dict:
        return self.get(id, "index_summary")

    def stats(self) -> dict:
        """Items by domain and by disposition, and in all."""
        rows = rows_of(index_stats(self.tier.read({"domain", "suggested_disposition"})).orderBy("dimension", F.asc_nulls_last("key")))
        whole = sum(r["count"] for r in rows if r["dimension"] == "domain")
        return self._wrap("index_stats", rows, (), total=whole)

    def briefing(self, days: int = 3, limit: int = 15, recent_days: int = 14) -> dict:
        """Three ranked lists in one call, cut to 24 KiB as text; see :func:`briefing_rows`."""
        for name, value, most in (("days", days, 31), ("limit", limit, 50), ("recent_days", recent_days, 90)):
            if isinstance(value, bool) or not 1 <= value <= most:
                raise ValueError(f"{name} takes 1 to {most}")
        ranked = briefing_rows(self.tier, self.now(), days, recent_days)
        first = rows_of(ranked.filter(F.col("place") <= limit).orderBy("rank", "place"))
        counts = briefing_counts(ranked)
        total = sum(counts[s] for s in SECTIONS)
        listed = {s: [{c: r[c] for c in BRIEFING_COLUMNS} for r in first if r["section"] == s] for s in SECTIONS}
        listed = {s: marked(rows, ("one_line",), ("one_line",)) for s, rows in listed.items()}

        def framed(sections: dict, dropped: int) -> dict:
            return wrap([], server=f"postmere-{self.name}", tool="index_briefing", tier=self.name, untrusted=("one_line",), total=total, truncated=dropped > 0, sections=sections, extra={"counts": counts, "dropped": dropped})

        return framed(*fitted(listed, lambda s, n: len(json.dumps(framed(s, n), default=str, ensure_ascii=False, indent=2).encode())))


def index_stats(rows: DataFrame) -> DataFrame:
    """``dimension, key, count`` by domain and by disposition, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(c).alias("key")) for name, c in (("domain", "domain"), ("disposition", "suggested_disposition"))]))
    return rows.select(pairs.alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("count"))


def briefing_windows(now: dt.datetime, days: int, recent_days: int) -> dict[str, Column]:
    """When a row belongs to each section: in either of two windows, deadlines from a week ago on, or recent mail."""
    today = now.astimezone(dt.UTC).date()
    until = lambda n: today + dt.timedelta(days=n + 1)
    deadline = lambda n: (F.col("deadline") >= F.lit(today - dt.timedelta(days=OVERDUE))) & (F.col("deadline") < F.lit(until(n)))
    recent = F.unix_micros("sent_at") >= F.lit(round((now - dt.timedelta(days=recent_days)).timestamp() * 1_000_000))
    yes = lambda c: F.coalesce(c, F.lit(False))
    soon = yes(deadline(AHEAD)) | yes(recent)
    return {"due_soon": yes(deadline(days)) | yes(F.col("time_sensitive") & recent), "action_items": yes(F.col("requires_action")) & soon, "waiting_on_me": yes(F.col("waiting_on") == "me") & soon}


def briefing_rows(tier: engine.Tier, now: dt.datetime, days: int = 3, recent_days: int = 14) -> DataFrame:
    """``section, rank, place`` and the briefing's columns: each row in the first section that holds it, placed by deadline
    (due_soon) or priority.

    One pass with both windows of a section as one condition replaces two queries and their union. Places come from a
    window over each section; sections are bounded by what is due or recent, and the heads are cut per part first (the
    report lists at most 50 rows a section).
    """
    windows = briefing_windows(now, days, recent_days)
    rows = tier.read({*BRIEFING_COLUMNS, "time_sensitive", "requires_action"})
    rank = F.lit(None).cast("int")
    for k, s in reversed(list(enumerate(SECTIONS))):
        rank = F.when(windows[s], F.lit(k)).otherwise(rank)
    rows = rows.select(*BRIEFING_COLUMNS, "time_sensitive", rank.alias("rank")).filter("rank is not null").withColumn("section", F.get(F.array(*map(F.lit, SECTIONS)), F.col("rank")))
    order = [F.when(F.col("rank") == 0, F.col("deadline")).asc_nulls_last(), *engine.ORDER_BY["priority"]()]
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    heads = rows.withColumn("_head", F.row_number().over(Window.partitionBy("rank", part).orderBy(*order)) <= 50)
    placed = heads.filter("_head").withColumn("place", F.row_number().over(Window.partitionBy("rank").orderBy(*order)))
    rest = heads.filter("not _head").withColumn("place", F.lit(1 << 30))
    return placed.unionByName(rest).select("section", "rank", "place", *BRIEFING_COLUMNS)


def tally(rows: DataFrame, key: Column, top: int = TOP) -> DataFrame:
    """``key, n``: counts by value, all but the *top* ones summed as ``(other)``. The top ones come from a sort with a
    limit, so no task orders every group; their number bounds what is broadcast."""
    counts = rows.groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), F.asc("key")).limit(top).select("key", F.lit(True).alias("_top"))
    named = counts.join(F.broadcast(first), "key", "left")
    return named.groupBy(F.when(F.col("_top"), F.col("key")).otherwise("(other)").alias("key")).agg(F.sum("n").alias("n"))


def briefing_counts(ranked: DataFrame) -> dict:
    """Sizes of the sections and the rows by domain and by source; at most 21 rows each come to the driver."""
    sizes = {r["section"]: r["count"] for r in ranked.groupBy("section").count().collect()}
    named = lambda c: {r["key"]: r["n"] for r in sorted(tally(ranked, F.col(c)).collect(), key=lambda r: (r["key"] == "(other)", -r["n"], r["key"]))}
    return {**{s: sizes.get(s, 0) for s in SECTIONS}, "by_domain": named("domain"), "by_source": named("source"), "complete": True}


def fitted(sections: dict[str, list[dict]], size: Callable[[dict, int], int], most: int = BRIEFING_BYTES) -> tuple[dict[str, list[dict]], int]:
    """The sections without as few of their lowest rows as make the result fit, and how many went: the deepest first, of equal
    depth that of the lower section. The size falls with each row, so the number is found by bisection."""
    depth = sorted(((i, k) for k, s in enumerate(SECTIONS) for i in range(len(sections[s]))), reverse=True)

    def without(n: int) -> dict[str, list[dict]]:
        gone = Counter(k for _, k in depth[:n])
        return {s: sections[s][: len(sections[s]) - gone[k]] for k, s in enumerate(SECTIONS)}

    n = bisect.bisect_left(range(len(depth)), True, key=lambda n: size(without(n), n) <= most)
    return without(n), n
