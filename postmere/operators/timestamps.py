"""Normalising timestamps of mixed layouts and zones to one instant in UTC."""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmere.functions.timestamps import literal_map, one_of, parse_fields, where_known, with_instant
from postmere.sources.tables import canonical, materialize

ZONES = sorted(z for z in zoneinfo.available_timezones() if "/" in z)
#: Zones by which a history is named before others that equal it.
CANDIDATES = ("UTC", "Europe/London", "Europe/Oslo", "Asia/Kolkata", "Australia/Sydney", "America/New_York", "America/Los_Angeles")


def abbreviations(zone: str) -> dict[str, int]:
    """The abbreviations that an IANA zone has used since 2000, with their offsets in minutes."""
    info, out = zoneinfo.ZoneInfo(zone), {}
    for k in range(4 * 40):
        at = dt.datetime(2000, 1, 15, 12, tzinfo=dt.UTC).replace(year=2000 + k // 4, month=1 + 3 * (k % 4)).astimezone(info)
        if (name := at.tzname() or "").isalpha():
            out[name.lower()] = round(at.utcoffset().total_seconds() / 60)
    return out


@functools.cache
def history(zone: str, first: int = 1970, last: int = 2038) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The wall times (seconds) from which on a zone's offsets hold, and these offsets in seconds.

    A wall time that occurs twice or is skipped has the offset before the change, so an offset holds from the later of
    the two wall times of its change on: the rule of ``to_utc_timestamp``.
    """
    info, epoch = zoneinfo.ZoneInfo(zone), dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    offset = lambda t: int((epoch + dt.timedelta(seconds=t)).astimezone(info).utcoffset().total_seconds())
    lo, hi = (int(dt.datetime(y, 1, 1, tzinfo=dt.UTC).timestamp()) for y in (first, last))
    starts, offsets = [-(1 << 62)], [offset(lo)]
    for t in range(lo, hi, 7 * 86400):
        if offset(t + 7 * 86400) == offsets[-1]:
            continue
        a, b = t, t + 7 * 86400
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if offset(mid) == offsets[-1] else (a, mid)
        starts.append(b + max(offsets[-1], offset(b)))
        offsets.append(offset(b))
    return tuple(starts), tuple(offsets)


def distinct_histories(spark, preferred: list[str]) -> list[str]:
    """A zone for each distinct offset history of the tz database since 1970, the *preferred* and common names first."""
    known = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    named = dict.fromkeys(z for z in [*CANDIDATES, *preferred, *ZONES] if z in known)
    first: dict[tuple, str] = {}
    for z in named:
        first.setdefault(history(z), z)
    return list(first.values())


def _fields(records: DataFrame) -> DataFrame:
    return records.select(F.col("delivery_id"), F.coalesce(canonical(F.col("source")), F.lit("")).alias("_src"), F.col("delivered_at").alias("_arrived"), where_known(parse_fields(F.col("sent_at"))).alias("_f"))


def declared_zones(sources: DataFrame) -> DataFrame:
    """``_src, _zone, _order`` of a source list; a listed source without a zone is in UTC.
    Of a source listed twice, the smallest zone and order hold."""
    return sources.filter(F.col("source").isNotNull()).groupBy(canonical(F.col("source")).alias("_src")).agg(
        F.coalesce(F.min(F.when(one_of("time_zone", [*ZONES, "UTC"]), F.col("time_zone"))), F.lit("UTC")).alias("_zone"),
        F.coalesce(F.min("date_order"), F.lit("dmy")).alias("_order"),
    )


def _zoneless(fields: DataFrame) -> DataFrame:
    f = lambda i: F.get("_f", F.lit(i))
    return fields.filter((f(0) != "epoch") & (F.coalesce(f(9), F.lit("")) == "") & (F.coalesce(f(10), F.lit("")) == ""))


def zone_scores(fields: DataFrame, candidates: list[str], slack_s: int = 120) -> DataFrame:
    """For each source and candidate history, how well it aligns its zone-less local times with ingestion.

    A value read in the right zone lies before its delivery, and shortly before it. ``violations`` counts values
    that would have been sent after their delivery (by more than *slack_s*), ``lag`` sums the hours by which the
    others lie before it, each cut at 12 so that truly late deliveries, which fit every zone alike, don't decide;
    ``n`` counts the values that are possible dates in that order. Both day orders are tried, as a source's order is unknown too.
    Each value's wall time is parsed once an order, and all candidates are read off their tables of offsets. Sums of a batch
    are added up in one aggregation; its result has one row per source, candidate and order, whatever the number of records.
    """
    no_own = F.create_map(F.lit(""), F.lit(0))
    rows = _zoneless(fields).filter(F.col("_arrived").isNotNull()).withColumn("order", F.explode(F.array(F.lit("dmy"), F.lit("mdy"))))
    rows = with_instant(rows.select("_src", "_arrived", "_f", "order"), "_f", F.lit("UTC"), F.col("order"), no_own, ZONES, "_wall")
    rows = rows.select("_src", "order", F.unix_micros("_arrived").alias("_arrived"), "_wall")
    tables = [history(z) for z in candidates]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [(np.array(t, dtype=np.int64), np.array(o, dtype=np.int64)) for t, o in tables]
        for pdf in batches:
            if not len(pdf):
                continue
            keys, groups = pd.factorize(pd.MultiIndex.from_frame(pdf[["_src", "order"]]))
            wall, arrived = pdf["_wall"].to_numpy(dtype=np.int64), pdf["_arrived"].to_numpy(dtype=np.int64)
            seconds, n = wall // 1_000_000, np.bincount(keys)
            for rank, (zone, (starts, offsets)) in enumerate(zip(candidates, known, strict=True)):
                lag = (arrived - wall + offsets[np.searchsorted(starts, seconds, side="right") - 1] * 1_000_000) / 3.6e9
                yield pd.DataFrame({
                    "_src": [g[0] for g in groups], "zone": zone, "order": [g[1] for g in groups], "rank": rank, "n": n,
                    "violations": np.bincount(keys, lag < -slack_s / 3600).astype(np.int64), "lag": np.bincount(keys, np.clip(lag, 0.0, 12.0)),
                })

    sums = rows.mapInPandas(run, "_src string, zone string, order string, rank int, n bigint, violations bigint, lag double")
    return sums.groupBy("_src", "zone", "order", "rank").agg(F.sum("n").alias("n"), F.sum("violations").alias("violations"), F.sum("lag").alias("lag"))


def _cost():
    """Hours by which a history misses: a violation or an impossible date costs the
    12 hours at which lags are cut, so that a single wrong clock doesn't outweigh the lag of all other values."""
    return F.round((F.col("violations") - F.col("n")) * 12 + F.col("lag"), 6)


def estimate_zones(fields: DataFrame, candidates: list[str]) -> DataFrame:
    """The history with the least cost, of equals the first candidate."""
    best = F.min_by(F.struct("zone", "order"), F.struct(_cost(), "rank", "order"))
    return zone_scores(fields, candidates).groupBy("_src").agg(best.alias("_b")).select("_src", F.col("_b.zone").alias("_zone"), F.col("_b.order").alias("_order"))


#: What a declared zone may miss by and still hold: hours in all, and hours a value.
TRUST, TRUST_EACH = 24.0, 0.25


def choose_zones(fields: DataFrame, sources: DataFrame) -> DataFrame:
    """``_src, _zone, _order`` of each source, by the alignment of its local times with ingestion, with what was declared and how the two fit.

    All distinct histories of the tz database are candidates for every source. A declared zone and order are a prior:
    they hold unless the best history fits better by more than :data:`TRUST` hours in all and :data:`TRUST_EACH`
    hours a value, so a handful of values or wrong clocks doesn't overrule the list, and a list that is plainly wrong doesn't overrule the values.
    """
    declared = declared_zones(sources)
    # one row per IANA zone in use: at most the size of the tz database
    zones = sorted({r[0] for r in declared.select("_zone").distinct().collect()})
    candidates = distinct_histories(fields.sparkSession, zones)
    stands = {history(z): z for z in reversed(candidates)}
    alias = F.create_map(*[F.lit(x) for z in zones for x in (z, stands[history(z)])]) if zones else F.create_map(F.lit(""), F.lit(""))
    scores = materialize(zone_scores(fields, candidates), "scores")
    best = scores.groupBy("_src").agg(F.min_by(F.struct("zone", "order", _cost().alias("cost"), "n", "violations"), F.struct(_cost(), "rank", "order")).alias("_b"))
    named = declared.select("_src", F.col("_zone").alias("_declared"), F.col("_order").alias("_declared_order"), F.try_element_at(alias, F.col("_zone")).alias("zone"))
    own = scores.join(named.select("_src", "zone", F.col("_declared_order").alias("order")), ["_src", "zone", "order"]).select("_src", _cost().alias("_own"), F.col("violations").alias("declared_violations"))
    both = named.drop("zone").join(best, "_src", "full").join(own, "_src", "left")
    holds = F.col("_declared").isNotNull() & (F.col("_b").isNull() | (F.coalesce(F.col("_own"), F.lit(0.0)) <= F.col("_b.cost") + TRUST + TRUST_EACH * F.col("_b.n")))
    return both.select(
        "_src", F.when(holds, F.col("_declared")).otherwise(F.coalesce("_b.zone", F.lit("UTC"))).alias("_zone"), F.when(holds, F.col("_declared_order")).otherwise(F.coalesce("_b.order", F.lit("dmy"))).alias("_order"),
        F.col("_b.zone").alias("_best"), F.col("_b.order").alias("_best_order"), "_declared", "_declared_order", F.col("_b.violations").alias("violations"), "declared_violations",
    )


def normalize_timestamps(records: DataFrame, sources: DataFrame, max_sources: int = 100_000) -> DataFrame:
    """``delivery_id, sent_us``: each delivery whose ``sent_at`` names an instant, with microseconds since 1970 UTC.

    Zone and day order of values without them are found by the alignment of local times with ingestion times, with the
    source list's as a prior (:func:`choose_zones`). Null, empty, impossible or unreadable values and bare days give no row. A null or
    unknown source counts as one undeclared source; without any delivery time to align with it is read as UTC,
    day first. Repeated rows give repeated results; other columns are ignored. The zones are broadcast while
    there are at most *max_sources* sources, and joined otherwise.
    """
    fields = _fields(records)
    chosen = materialize(choose_zones(fields, sources).select("_src", "_zone", "_order"), "zones")
    hint = F.broadcast if chosen.limit(max_sources + 1).count() <= max_sources else (lambda x: x)
    own = _own_map(sorted({*CANDIDATES, *(r[0] for r in chosen.select("_zone").distinct().collect())}))
    joined = fields.join(hint(chosen), "_src", "left")
    zone = F.coalesce("_zone", F.lit("UTC"))
    done = with_instant(joined, "_f", zone, F.coalesce("_order", F.lit("dmy")), F.try_element_at(own, zone), ZONES, "sent_us")
    return done.select("delivery_id", "sent_us")


def _own_map(zones: list[str]):
    pairs = []
    for z in zones:
        pairs += [F.lit(z), literal_map(abbreviations(z) or {"utc": 0})]
    return F.create_map(*pairs)
