"""Processing only what was added or changed since the last successful run."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """What a run fixes at its start: the newest commit it will look at, and the policy in force."""

    upper_us: int | None
    policy: str | None


def latest_enrichments(enrichments: DataFrame) -> DataFrame:
    """``doc_id, enriched_us``: each document with an enrichment, and the newest commit time of one; one shuffle on
    the document, combined before it, so a document that fills a third of the log is a row per partition.

    Rejections (no enrichment) don't count. A document all of whose enrichments lack a time has a NULL time.
    Rows without doc_id are no document.
    """
    rows = enrichments.filter(F.col("doc_id").isNotNull() & F.col("enrichment").isNotNull())
    return rows.groupBy("doc_id").agg(F.max(F.unix_micros("enriched_at")).alias("enriched_us"))


def holding_rows(messages: DataFrame) -> DataFrame:
    """``doc_id, done_us, done_policy``: of the rows of an id that with the latest ``synced_at`` (of equal ones, the
    latest ``enriched_at``, then the greatest ``policy_hash``; NULL is least everywhere)."""
    newest = F.max(F.struct("synced_at", F.unix_micros("enriched_at").alias("done_us"), "policy_hash")).alias("_h")
    rows = messages.filter(F.col("id").isNotNull()).withColumnRenamed("id", "doc_id").groupBy("doc_id").agg(newest)
    return rows.select("doc_id", F.col("_h.done_us").alias("done_us"), F.col("_h.policy_hash").alias("done_policy"))


def bounds(enrichments: DataFrame, runs: DataFrame) -> Bounds:
    """The upper limit and the policy, read once. The current policy is that of the greatest ``run_id``."""
    policy = runs.agg(F.max_by("policy_hash", "run_id")).first()[0]
    upper = enrichments.filter(F.col("enrichment").isNotNull()).agg(F.max(F.unix_micros("enriched_at"))).first()[0]
    return Bounds(upper, policy)


def last_success(runs: DataFrame, policy: str | None) -> int | None:
    """When the last successful run under the current policy began: commits up to then it should have processed."""
    same = F.col("policy_hash").eqNullSafe(F.lit(policy))
    return runs.filter((F.col("status") == "ok") & same).agg(F.max(F.unix_micros("started_at"))).first()[0]


def between(enrichments: DataFrame, low_us: int | None, high_us: int | None) -> DataFrame:
    """The log's rows with a commit time above *low_us* and up to *high_us*, as comparisons of the column, which reach the scan.
    Rows without a time belong to the range without a lower end."""
    at, stamp = F.col("enriched_at"), lambda us: F.timestamp_micros(F.lit(us))
    rows = enrichments
    if high_us is not None:
        rows = rows.filter((at <= stamp(high_us)) | (at.isNull() if low_us is None else F.lit(False)))
    return rows if low_us is None else rows.filter(at > stamp(low_us))


def decide(latest: DataFrame, messages: DataFrame, policy: str | None) -> DataFrame:
    """``doc_id, enriched_us, reason`` of documents with their newest commit: ``new``, ``changed``, ``policy``, or NULL if nothing is to do."""
    both = latest.join(holding_rows(messages).withColumn("_held", F.lit(True)), "doc_id", "left")
    reason = (
        F.when(F.col("_held").isNull(), "new")
        .when(~F.col("done_us").eqNullSafe(F.col("enriched_us")), "changed")
        .when(~F.col("done_policy").eqNullSafe(F.lit(policy)), "policy")
    )
    return both.select("doc_id", "enriched_us", reason.alias("reason"))


def pending(enrichments: DataFrame, messages: DataFrame, at: Bounds) -> DataFrame:
    """``doc_id, enriched_us, reason``: the documents that a run without a watermark must process, up to its upper limit.

    A document's place in the commit sequence is its newest ``enriched_at``; what holds of it is its row in *messages*, for
    runs that failed wrote some rows and skipped others. ``reason``: ``new``, ``changed`` or ``policy``. Rows of commits beyond the limit
    wait for the next run.
    """
    return decide(latest_enrichments(between(enrichments, None, at.upper_us)), messages, at.policy).filter("reason is not null")


class CommitLog:
    """Batches of output and the watermark they reach, valid together or not at all.

    A batch is written below ``b=<n>`` and counts once ``b=<n>/committed`` exists, one rename after all else. A run
    that dies leaves no mark; the next one starts from the last valid watermark and writes the same number anew, so
    nothing is skipped and nothing is there twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        if not self._fs.exists(self._p(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("b=") and self._fs.exists(self._p(f"{self.path}/{n}/committed")))

    def watermark(self) -> dict:
        """What the last valid batch recorded; empty before the first."""
        done = self.batches()
        if not done:
            return {}
        source = self._fs.open(self._p(f"{self.path}/b={done[-1]}/committed"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def commit(self, rows: DataFrame, watermark: dict) -> int:
        """Write *rows* as the next batch and make it and *watermark* valid in one step."""
        n = max(self.batches(), default=-1) + 1
        at = f"{self.path}/b={n}"
        rows.write.mode("overwrite").parquet(f"{at}/rows")
        tmp = self._p(f"{at}/committing")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(watermark).encode()))
        out.close()
        if not self._fs.rename(tmp, self._p(f"{at}/committed")):
            raise OSError(f"batch {n} could not be committed")
        return n

    def read(self) -> DataFrame:
        """The rows of all valid batches, with the number of each in ``batch``."""
        frames = [self.spark.read.schema(DECISION).parquet(f"{self.path}/b={n}/rows").withColumn("batch", F.lit(n)) for n in self.batches()]
        if not frames:
            return self.spark.createDataFrame([], f"{DECISION}, batch int")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def standing(self) -> DataFrame:
        """The last decision on each document: that of the greatest batch."""
        last = self.read().groupBy("doc_id").agg(F.max_by(F.struct("enriched_us", "policy", "reason"), "batch").alias("_d"))
        return last.select("doc_id", "_d.*")


DECISION = "doc_id string, enriched_us bigint, reason string, policy string"


def run_incremental(enrichments: DataFrame, messages: DataFrame, runs: DataFrame, log: CommitLog, *, upper_us: int | None = None, lateness_us: int = 0) -> int | None:
    """Decide on what was committed since the log's watermark and commit the decisions with the new watermark; the batch's
    number, or None if nothing is new.

    The upper limit is fixed first (*upper_us*, or the newest commit). Of the enrichments only rows above the watermark are
    read (from *lateness_us* before it on, for logs whose rows come late), for the newest commit of a document
    that has any is among them; documents of a batch that stand as they were decided before are left out. Another policy concerns every document,
    so it starts from the log's beginning. A run that dies leaves no mark, and the next one starts from the same watermark.
    """
    at = bounds(enrichments, runs)
    upper = at.upper_us if upper_us is None else upper_us
    mark = log.watermark()
    low = mark.get("upper_us") if mark.get("policy") == at.policy and mark else None
    if low is not None and upper is not None and upper <= low and not lateness_us:
        return None
    found = decide(latest_enrichments(between(enrichments, None if low is None else low - lateness_us, upper)), messages, at.policy)
    found = found.withColumn("policy", F.lit(at.policy).cast("string"))
    if mark:
        was = log.standing().select("doc_id", F.struct("enriched_us", "policy").alias("_was"))
        found = found.join(was, "doc_id", "left").filter(~F.struct("enriched_us", "policy").eqNullSafe(F.col("_was"))).drop("_was")
    return log.commit(found, {"upper_us": upper, "policy": at.policy})


def catch_up(enrichments: DataFrame, messages: DataFrame, runs: DataFrame, log: CommitLog) -> DataFrame:
    """``doc_id, enriched_us, reason`` of everything that is to be processed, after the runs that *log* still lacks.

    The first goes up to the start of the last successful run under the current policy, over what that one should have
    processed, and finds what it and failed ones left; the second reads only what was committed since. What a run found stands until a
    later one decides otherwise.
    """
    at = bounds(enrichments, runs)
    done = last_success(runs, at.policy)
    if not log.batches() and done is not None and at.upper_us is not None and done < at.upper_us:
        run_incremental(enrichments, messages, runs, log, upper_us=done)
    run_incremental(enrichments, messages, runs, log)
    return log.standing().filter("reason is not null").select("doc_id", "enriched_us", "reason")
