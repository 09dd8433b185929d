"""Timestamps, repeated deliveries and incremental batches on small tables."""

import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from postmere.operators import incremental
from postmere.operators.messageid import parse_id
from postmere.operators.timestamps import estimate_zones, normalize_timestamps
from postmere.operators.timestamps import _fields as fields
from postmere.sources.tables import scratch
from postmere.streaming import dedup

R = "delivery_id bigint, source string, sent_at string, delivered_at timestamp"
SOURCES = [("a", "Europe/Oslo", "dmy"), ("b", "America/New_York", "mdy"), ("u", None, "dmy"), ("k", "Asia/Kolkata", "dmy")]


def us(text, zone="UTC", fold=0):
    local = dt.datetime.fromisoformat(text).replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=fold)
    return round((local - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))


CASES = [
    ("a", "2023-01-01T01:36:19Z", us("2023-01-01 01:36:19")), ("a", "20230104T160548Z", us("2023-01-04 16:05:48")), ("a", "2023-01-01 18:29:07", us("2023-01-01 18:29:07", "Europe/Oslo")),
    ("a", "02/01/2023 13:36", us("2023-01-02 13:36", "Europe/Oslo")), ("b", "02/01/2023 1:36 PM", us("2023-02-01 13:36", "America/New_York")), ("b", "12/5/2023 12:05 am", us("2023-12-05 00:05", "America/New_York")),
    ("a", "09.01.2023 kl. 07.20", us("2023-01-09 07:20", "Europe/Oslo")), ("a", "22.1.23 05:25", us("2023-01-22 05:25", "Europe/Oslo")), ("u", "26. Januar 2023, 04:58 Uhr", us("2023-01-26 04:58")),
    ("a", "14 janvier 2023 à 08h01", us("2023-01-14 08:01", "Europe/Oslo")), ("k", "Wed, 11 Jan 2023 20:07:24 IST", us("2023-01-11 20:07:24", "Asia/Kolkata")), ("a", "Sun, 02 Apr 2023 06:09:50 CEST", us("2023-04-02 04:09:50")),
    ("a", "Mon, 02 Jan 23 20:20:15 +0100 (CET)", us("2023-01-02 19:20:15")), ("a", "Sun Jan  1 02:32:32 2023", us("2023-01-01 02:32:32", "Europe/Oslo")), ("a", "2023-01-20T16:15:55.324781398+00:00", us("2023-01-20 16:15:55.324781")),
    ("a", "2023-01-02 20:04:40 Europe/London", us("2023-01-02 20:04:40", "Europe/London")), ("a", "2023-01-01T07:08:45+01:00[Europe/Oslo]", us("2023-01-01 06:08:45")), ("a", "1672951614", 1672951614_000000), ("a", "1672883569510", 1672883569510_000),
    ("a", "1675018190.432", 1675018190_432000), ("a", " 2023-01-19 17:05:12 ", us("2023-01-19 17:05:12", "Europe/Oslo")), ("a", "2023-03-26T02:30:00", us("2023-03-26 01:30:00")), ("a", "2023-10-29T02:30:00", us("2023-10-29 00:30:00")),
    ("b", "Wed, 08 Mar 2023 00:15:34 -0000", us("2023-03-08 00:15:34")), ("a", None, None), ("a", "", None), ("a", "n/a", None), ("a", "2023-02-30T19:10:21Z", None), ("a", "2024-13-19T16:11:46Z", None), ("a", "0000-00-00 00:00:00", None), ("a", "05.06.2023", None),
    ("a", "2023-01-01 10:00:00+99:00", None), ("a", "x" * 100_000, None), (None, "2023-01-01T01:36:19Z", us("2023-01-01 01:36:19")), (" A ", "2023-01-01 18:29:07", us("2023-01-01 18:29:07", "Europe/Oslo")),
]


def test_timestamps(spark):
    rows = spark.createDataFrame([(i, s, t, None) for i, (s, t, _) in enumerate(CASES)], R).withColumns({"_src": F.lit("clash"), "_f": F.lit(1), "sent_us": F.lit(0)})
    sources = spark.createDataFrame(SOURCES, "source string, time_zone string, date_order string")
    got = {r["delivery_id"]: r["sent_us"] for r in normalize_timestamps(rows, sources).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES) if want is not None}
    assert normalize_timestamps(rows.limit(0), sources.limit(0)).collect() == []


def test_zones_are_estimated_from_ingestion(spark):
    zone, data = zoneinfo.ZoneInfo("Asia/Kolkata"), []
    for k in range(60):
        sent = dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=5 * k, hours=k)
        data.append((k, "new", sent.astimezone(zone).strftime("%d/%m/%Y %H:%M"), sent + dt.timedelta(minutes=7 + k)))
    rows = spark.createDataFrame(data, R)
    best = estimate_zones(fields(rows), ["UTC", "Asia/Kolkata", "Europe/Oslo", "America/New_York"]).collect()
    assert [(r["_src"], r["_zone"], r["_order"]) for r in best] == [("new", "Asia/Kolkata", "dmy")]


@pytest.mark.parametrize("name", ["Asia/Tokyo", "America/Sao_Paulo", "America/Chicago", "Asia/Kathmandu"])
def test_unlisted_sources_of_any_zone(spark, name):
    zone, data = zoneinfo.ZoneInfo(name), []
    for k in range(48):
        sent = dt.datetime(2024, 1 + k % 12, 3 + k // 2, 9, 5 * (k % 12), tzinfo=dt.UTC)
        data.append((k, "elsewhere", sent.astimezone(zone).strftime("%Y-%m-%d %H:%M"), sent + dt.timedelta(minutes=1 + k % 7)))
    rows = spark.createDataFrame(data, "delivery_id bigint, source string, sent_at string, delivered_at timestamp")
    sources = spark.createDataFrame(SOURCES, "source string, time_zone string, date_order string")
    got = {r["delivery_id"]: r["sent_us"] for r in normalize_timestamps(rows, sources).collect()}
    assert got == {k: us(text, name) for k, _, text, _ in data}


D = "delivery_id bigint, delivered_at timestamp, source string, source_uid string, thread_id string, extra string"
DELIVERIES = [
    (1, "gmail:p", "18c2f4a9b0d1e7f3", None), (2, "Gmail:p ", "\t18C2F4A9B0D1E7F3", "t"), (3, "imap:w", "INBOX:1:7", "<m1@x>"), (4, "imap:w", "INBOX:01:007", None), (5, "imap:w", "Archive:2:9", "m1@x "), (6, "imap:w", "Archive:2:9", "<m2@x>"),
    (7, "imap:w", "Sent:3:1", "<m2@x>"), (8, "imap:h", "INBOX:1:7", "<m1@x>"), (9, "jmap:c", "Mab", None), (10, "jmap:c", "MaB", None), (11, None, None, None), (12, None, None, None), (13, "imap:w", "Sent:3:2", "<M2@x>"), (14, "imap:w", "X:5:5", "<>"), (15, "imap:w", "X:5:6", " "),
]
WANT = {(1, 2), (3, 4), (3, 5), (3, 6), (3, 7)}


@pytest.mark.parametrize("files", [1, 15])
def test_deduplication_by_batches(spark, files):
    path = scratch(spark, "deliveries")
    day0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(i, day0 + dt.timedelta(days=40 * i), s, u, t, "x" * 10) for i, s, u, t in DELIVERIES]
    for k in range(files):
        spark.createDataFrame(rows[k::files], D).coalesce(1).write.mode("append").parquet(path)
    root = scratch(spark, "root")
    store = dedup.deduplicate(spark, path, root=root, files_per_batch=4, compact=2)
    got = {tuple(r) for r in dedup.repeats(dedup.first_deliveries(store)).select("first_id", "delivery_id").collect()}
    assert got == WANT
    assert sum(store.has(v, "cold") for v in store.committed()) <= 3
    assert len(store.committed()) == (1 if files == 1 else 4)
    # a later call takes in only what is new, and finds copies whose identifiers have expired
    spark.createDataFrame([(99, day0 + dt.timedelta(days=4000), "gmail:p", "18c2f4a9b0d1e7f3", None, None)], D).coalesce(1).write.mode("append").parquet(path)
    store = dedup.deduplicate(spark, path, root=root, files_per_batch=4)
    got = {tuple(r) for r in dedup.repeats(dedup.first_deliveries(store)).select("first_id", "delivery_id").collect()}
    assert got == WANT | {(1, 99)}


def test_an_uncommitted_batch_is_taken_again(spark):
    path, root = scratch(spark, "deliveries"), scratch(spark, "root")
    spark.createDataFrame([(1, None, "a", "u", None, None), (2, None, "a", "u", None, None)], D).coalesce(1).write.parquet(path)
    store = dedup.SeenStore(spark, f"{root}/seen")
    fail = dedup.SeenMessages(store, 60)
    mark, store.mark = store.mark, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        fail(spark.read.parquet(path), 0)
    assert store.committed() == []
    store.mark = mark
    fail(spark.read.parquet(path), 0)
    fail(spark.read.parquet(path), 0)  # the stream repeats a committed batch
    assert [tuple(r) for r in dedup.repeats(dedup.first_deliveries(store)).collect()] == [(1, 2)]


E_SCHEMA = "doc_id string, enrichment struct<a: int>, enriched_at timestamp"
M_SCHEMA = "id string, enriched_at timestamp, policy_hash string, synced_at timestamp"


RUNS = "run_id bigint, policy_hash string, status string, started_at timestamp"


def t(k):
    return dt.datetime(2025, 1, k, tzinfo=dt.UTC)


def test_pending_and_commits(spark):
    e = spark.createDataFrame([("new", (1,), t(3)), ("same", (1,), t(2)), ("same", (1,), t(1)), ("same", (1,), t(2)), ("late", (1,), t(5)), ("policy", (1,), t(2)), ("nopolicy", (1,), t(2)), ("rejected", None, t(9)), ("notime", (1,), None), ("notime2", (1,), None), (None, (1,), t(1))], E_SCHEMA)
    m = spark.createDataFrame([("same", t(1), "p", t(3)), ("same", t(2), "p", t(4)), ("late", t(2), "p", t(4)), ("policy", t(2), "o", t(4)), ("nopolicy", t(2), None, t(4)), ("notime", None, "p", t(1)), ("notime2", t(1), "p", t(1)), ("gone", t(1), "o", t(1))], M_SCHEMA)
    runs = spark.createDataFrame([(2, "p", "ok", t(4)), (1, "o", "ok", t(1)), (3, "p", "failed", t(6))], RUNS)
    at = incremental.bounds(e, runs)
    got = {r["doc_id"]: r["reason"] for r in incremental.pending(e, m, at).collect()}
    assert got == {"new": "new", "late": "changed", "policy": "policy", "nopolicy": "policy", "notime2": "changed"}
    log = incremental.CommitLog(spark, scratch(spark, "log"))
    assert incremental.run_incremental(e, m, runs, log) == 0
    assert incremental.run_incremental(e, m, runs, log) is None  # nothing twice
    later = e.unionByName(spark.createDataFrame([("new", (1,), t(8))], E_SCHEMA))
    assert incremental.run_incremental(later, m, runs, log) == 1
    assert sorted(r["doc_id"] for r in log.read().filter("reason is not null").collect()) == ["late", "new", "new", "nopolicy", "notime2", "policy"]
    assert {r["doc_id"] for r in log.standing().filter("reason is not null").collect()} == {"late", "new", "nopolicy", "notime2", "policy"}
    empty = e.limit(0)
    assert incremental.pending(empty, m, incremental.bounds(empty, runs.limit(0))).collect() == []


def test_a_batch_without_its_mark_does_not_count(spark):
    log = incremental.CommitLog(spark, scratch(spark, "log"))
    rows = spark.createDataFrame([("a", 1, "new", "p")], incremental.DECISION)
    rows.write.parquet(f"{log.path}/b=0/rows")  # a run that died before its commit
    assert log.batches() == [] and log.watermark() == {}
    assert log.commit(rows, {"upper_us": 7}) == 0
    assert log.watermark() == {"upper_us": 7} and log.read().count() == 1


@pytest.mark.parametrize(
    ("ref", "ok"),
    [("gmail:personal::18c2f4a9b0d1e7f3", True), ("imap:inbox-c::Arkiv/Året:1:7", True), ("imap:x::A::B:1:7", True), ("jmap:fastmail::Mf3a9b2c1-d4e5_f6", True), ("graph:office::AAkALgAAAAAAHYQDEapmEc2byACqAC-EWg0AAAA=", True),
     ("pop3:personal::18c2f4a9b0d1e7f3", False), ("gmail:personal::18C2F4A9B0D1E7F3", False), ("imap:inbox-c::INBOX:01:7", False), ("imap:inbox-c::INBOX:1:0", False), ("gmail:personal::18c2f4a9b0d1e7f3\n", False), ("imap:inbox.b::INBOX:1:7", False)],
)
def test_message_references(spark, ref, ok):
    got = spark.createDataFrame([(ref,)], "r string").select(parse_id(F.col("r")).alias("p")).first()["p"]
    assert (got is not None) == ok


def test_a_chain_of_three_hundred_copies(spark):
    from postmere.operators.components import component_labels

    pairs = [(f"a{k}", f"b{j}", k) for k in range(300) for j in (k, k + 1)]
    got = component_labels(spark.createDataFrame([*pairs, ("z", "y", 7)], "a string, b string, label bigint")).collect()
    assert {r["label"] for r in got} == {0} and len(got) == 300


def test_runs_read_only_beyond_the_watermark(spark):
    rows = [("a", (1,), t(1)), ("b", (1,), t(3)), ("a", (1,), t(6)), ("c", (1,), t(7))]
    e = spark.createDataFrame(rows, E_SCHEMA)
    m = spark.createDataFrame([("a", t(6), "p", t(8)), ("b", t(2), "p", t(3))], M_SCHEMA)
    runs = spark.createDataFrame([(1, "p", "ok", t(4))], RUNS)
    log = incremental.CommitLog(spark, scratch(spark, "log"))
    got = {r["doc_id"]: r["reason"] for r in incremental.catch_up(e, m, runs, log).collect()}
    assert got == {"b": "changed", "c": "new"}  # what the first run held against a was settled by the second
    assert {r["doc_id"] for r in log.read().filter("batch = 1").collect()} == {"a", "c"} and len(log.batches()) == 2
    plan = incremental.between(e, 5, 9)._jdf.queryExecution().toString()
    assert "enriched_at" in plan and incremental.between(e, 1_736_000_000_000_000, None).count() == 2
    # a run that dies before its commit leaves the watermark where it was
    commit, log.commit = log.commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    later = e.unionByName(spark.createDataFrame([("d", (1,), t(9))], E_SCHEMA))
    with pytest.raises(OSError):
        incremental.run_incremental(later, m, runs, log)
    log.commit = commit
    assert {r["doc_id"] for r in incremental.catch_up(later, m, runs, log).collect()} == {"b", "c", "d"}


def test_a_plainly_wrong_zone_of_the_list_does_not_hold(spark):
    from postmere.operators.timestamps import choose_zones

    zone, data = zoneinfo.ZoneInfo("Asia/Kolkata"), []
    for k in range(200):
        sent = dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=2 * k, hours=k)
        data += [(k, s, sent.astimezone(zone).strftime("%Y-%m-%d %H:%M"), sent + dt.timedelta(minutes=7)) for s in ("wrong", "few", "right") if s != "few" or k < 2]
    rows = spark.createDataFrame(data, R)
    sources = spark.createDataFrame([("wrong", "America/New_York", "dmy"), ("few", "America/New_York", "dmy"), ("right", "Asia/Kolkata", "dmy")], "source string, time_zone string, date_order string")
    got = {r["_src"]: r["_zone"] for r in choose_zones(fields(rows), sources).collect()}
    assert got == {"wrong": "Asia/Kolkata", "few": "America/New_York", "right": "Asia/Kolkata"}
