"""Queries of the general data-pipeline operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmere.operators import incremental, timestamps
from postmere.sources.tables import scratch, stored_bytes, table
from postmere.streaming import dedup


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalize_timestamps(table(spark, d, "records"), table(spark, d, "source_list"))


def p4_zones(spark: SparkSession, d: str) -> DataFrame:
    """For each source, the history that its local times fit best when aligned with ingestion, the declared one, and the one used."""
    records, sources = table(spark, d, "records"), table(spark, d, "source_list")
    chosen = timestamps.choose_zones(timestamps._fields(records), sources)
    return chosen.select(F.col("_src").alias("source"), F.col("_best").alias("estimated_zone"), F.col("_best_order").alias("estimated_order"), F.col("_declared").alias("declared_zone"), F.col("_declared_order").alias("declared_order"), F.col("_zone").alias("used_zone"), "violations", "declared_violations")


def _first(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries in batches, as they came: their files are read by the stream some at a time."""
    staged = scratch(spark, "deliveries")
    rows = table(spark, d, "records").select("delivery_id", "batch_id", "delivered_at", "source", "source_uid", "thread_id")
    files = 3 * max(1, -(-stored_bytes(spark, f"{d}/records.parquet") // (256 << 20)))
    rows.repartitionByRange(files, "batch_id", "delivery_id").drop("batch_id").write.parquet(staged)
    store = dedup.deduplicate(spark, staged, files_per_batch=files // 3)
    return dedup.first_deliveries(store)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeats(_first(spark, d))


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    """Messages and deliveries of each source, after the removal of repeats."""
    kept = _first(spark, d).groupBy(F.col("first_id").alias("delivery_id")).agg(F.count("*").alias("copies"))
    rows = table(spark, d, "records").select("delivery_id", "source").join(kept, "delivery_id")
    return rows.groupBy(F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source")).agg(F.count("*").alias("messages"), F.sum("copies").alias("deliveries"))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    log = incremental.CommitLog(spark, scratch(spark, "decisions"))
    return incremental.catch_up(table(spark, d, "enrichments"), table(spark, d, "messages"), table(spark, d, "sync_runs"), log)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).select("doc_id")


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _pending(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p4_found, p4_zones, p5_found, p5_sources, p6_found, p6_reasons)}

_P5 = r"""
WITH RECURSIVE base AS (
  SELECT delivery_id, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS src,
         regexp_replace(source_uid, '^\s+|\s+$', '', 'g') AS uid, regexp_replace(thread_id, '^[\s<>]+|[\s<>]+$', '', 'g') AS mid FROM records),
k AS (
  SELECT delivery_id, CASE WHEN src LIKE 'gmail:%' THEN 'u' || src || lower(uid)
    WHEN src LIKE 'imap:%' THEN 'u' || src || regexp_replace(uid, '^(.*):0*([1-9][0-9]*):0*([1-9][0-9]*)$', '\1:\2:\3')
    ELSE 'u' || src || uid END AS key FROM base WHERE src IS NOT NULL AND uid IS NOT NULL
  UNION ALL SELECT delivery_id, 'm' || src || mid FROM base WHERE src LIKE 'imap:%' AND mid <> ''),
star AS (SELECT delivery_id, min(delivery_id) OVER (PARTITION BY key) AS hub FROM k),
edge AS (SELECT delivery_id AS a, hub AS b FROM star WHERE delivery_id <> hub UNION SELECT hub, delivery_id FROM star WHERE delivery_id <> hub),
reach AS (SELECT delivery_id AS d, delivery_id AS r FROM base UNION SELECT reach.d, edge.b FROM reach JOIN edge ON edge.a = reach.r),
first AS (SELECT d AS delivery_id, min(r) AS first_id FROM reach GROUP BY d)
"""
_P6 = """
WITH e AS (SELECT doc_id, max(enriched_at) AS at FROM enrichments WHERE enrichment IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT id, enriched_at, policy_hash FROM messages QUALIFY row_number() OVER (
  PARTITION BY id ORDER BY synced_at DESC NULLS LAST, enriched_at DESC NULLS LAST, policy_hash DESC NULLS LAST) = 1),
p AS (SELECT policy_hash FROM sync_runs ORDER BY run_id DESC LIMIT 1),
r AS (SELECT e.doc_id, CASE WHEN h.id IS NULL THEN 'new' WHEN h.enriched_at IS DISTINCT FROM e.at THEN 'changed'
  WHEN h.policy_hash IS DISTINCT FROM (SELECT policy_hash FROM p) THEN 'policy' END AS reason FROM e LEFT JOIN h ON h.id = e.doc_id)
"""
ORACLES = {
    "p5_found": _P5 + "SELECT first_id, delivery_id FROM first WHERE first_id <> delivery_id",
    "p5_sources": _P5
    + r"""SELECT src AS source, count(DISTINCT first_id) AS messages, CAST(count(*) AS BIGINT) AS deliveries FROM (
  SELECT f.delivery_id, f.first_id, b.src FROM first f JOIN base b ON b.delivery_id = f.first_id) GROUP BY src""",
    "p6_found": _P6 + "SELECT doc_id FROM r WHERE reason IS NOT NULL",
    "p6_reasons": _P6 + "SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason",
}
