"""Exactly-once messages from an at-least-once stream of deliveries.

Each micro-batch looks its identifiers up in a keyed state of those seen before, writes its output and the new state
below one directory, and makes both valid at once by one rename. The state has two parts: the hot one holds
identifiers seen within the watermark delay of event time; those that expire move to the cold one, which answers only
for identifiers that the hot part doesn't know, so a copy that arrives months late is still found.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmere.operators.components import component_labels
from postmere.operators.messageid import canonical_message_id, canonical_source, canonical_uid
from postmere.sources.tables import materialize, scratch

STATE = "key string, label bigint, seen timestamp"
OUTPUT = "key string, delivery_id bigint"
ALIAS = "key string, label bigint"


def delivery_keys(records: DataFrame) -> DataFrame:
    """``delivery_id, seen, key, alt``: the identifier of each delivery, and for IMAP that of its Message-ID.

    A delivery without source or uid has no identifier of its own kind: it counts as a message of its own,
    unless its Message-ID joins it to others.
    """
    src = canonical_source(F.col("source"))
    rows = records.select("delivery_id", F.col("delivered_at").alias("seen"), src.alias("_src"), canonical_uid(src, F.col("source_uid")).alias("_uid"), canonical_message_id(F.col("thread_id")).alias("_mid"))
    return rows.select(
        "delivery_id", "seen",
        F.coalesce(F.concat(F.lit("u:"), "_src", F.lit("::"), "_uid"), F.concat(F.lit("d:"), F.col("delivery_id").cast("string"))).alias("key"),
        F.when(F.col("_src").startswith("imap:"), F.concat(F.lit("m:"), "_src", F.lit("::"), "_mid")).alias("alt"),
    )


class SeenStore:
    """The identifiers seen so far, as versions below one directory of the shared folder.

    ``v=<n>`` holds ``hot``, ``cold`` (those that version *n* expired), ``links`` and ``out`` of batch *n*. A version
    counts once its ``committed`` file exists, which is renamed into place after all else is written; what a lost
    batch left is overwritten when the stream repeats that batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        root = self._p(self.path)
        if not self._fs.exists(root):
            return []
        at = [s.getPath() for s in self._fs.listStatus(root)]
        return sorted(int(p.getName()[2:]) for p in at if p.getName().startswith("v=") and self._fs.exists(self._p(p, "committed")))

    def read(self, part: str, versions: list[int], schema: str) -> DataFrame:
        paths = [f"{self.path}/v={v}/{part}" for v in versions]
        paths = [p for p in paths if self._fs.exists(self._p(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def mark(self, version: int, meta: dict) -> None:
        """Make a version valid: its meta file appears under its final name in one step."""
        tmp, at = self._p(f"{self.path}/v={version}/committing"), self._p(f"{self.path}/v={version}/committed")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        if not self._fs.rename(tmp, at):
            raise OSError(f"could not commit version {version}")

    def meta(self, version: int) -> dict:
        source = self._fs.open(self._p(f"{self.path}/v={version}/committed"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def has(self, version: int, part: str) -> bool:
        return self._fs.exists(self._p(f"{self.path}/v={version}/{part}"))

    def drop(self, version: int, part: str) -> None:
        self._fs.delete(self._p(f"{self.path}/v={version}/{part}"), True)


class SeenMessages:
    """The stream's batch function: one instance a store; see the module's text."""

    def __init__(self, store: SeenStore, delay_s: int, compact: int = 8):
        self.store, self.delay_s, self.compact = store, delay_s, compact

    def __call__(self, batch: DataFrame, version: int) -> None:
        done = self.store.committed()
        if version in done:  # the stream repeats a batch that was committed just before a failure
            return
        done = [v for v in done if v < version]
        last = done[-1:]
        rows = delivery_keys(batch)
        # combined before the shuffle, so a message delivered a million times is a row per partition
        fresh = rows.groupBy("key", "alt").agg(F.min("delivery_id").alias("label"), F.max("seen").alias("seen"), F.count("*").alias("n"))
        fresh = materialize(fresh, "fresh")
        keys = fresh.select("key", "label", "seen").unionByName(fresh.filter("alt is not null").select(F.col("alt").alias("key"), "label", "seen"))
        keys = keys.groupBy("key").agg(F.min("label").alias("label"), F.max("seen").alias("seen"))
        if last:
            hot = self.store.read("hot", last, STATE)
            cold = self.store.read("cold", done, STATE)
            known = hot.join(keys.select("key"), "key", "left_semi").select("key", F.col("label").alias("was"))
            late = cold.join(keys.join(hot, "key", "left_anti").select("key"), "key", "left_semi").select("key", F.col("label").alias("was"))
            was = known.unionByName(late).groupBy("key").agg(F.min("was").alias("was"))
            keys = keys.join(was, "key", "left")
        else:
            hot, keys = None, keys.withColumn("was", F.lit(None).cast("bigint"))
        keys = materialize(keys, "keys")
        # what ties identifiers together: those of one delivery, and those that the state gave the same label
        pairs = fresh.filter("alt is not null").select(F.col("key").alias("a"), F.col("alt").alias("b"))
        pairs = pairs.unionByName(keys.filter("was is not null").select(F.col("key").alias("a"), F.concat(F.lit("l:"), F.col("was").cast("string")).alias("b")))
        pairs = pairs.unionByName(keys.filter("was is not null and key like 'm:%'").select(F.col("key").alias("a"), F.col("key").alias("b"))).distinct()
        own = keys.select(F.col("key").alias("a"), F.least("label", F.coalesce("was", "label")).alias("label"))
        settled = component_labels(pairs.join(own, "a"))
        joined = keys.join(settled.select(F.col("a").alias("key"), F.col("label").alias("all")), "key", "left")
        joined = joined.select("key", F.least(F.coalesce("all", "label"), F.coalesce("was", "label"), "label").alias("label"), "seen", "was")
        labelled = joined
        at = f"{self.store.path}/v={version}"
        # an alternative identifier takes the label of its message
        alt = fresh.filter("alt is not null").select("key", "alt").distinct().join(labelled.select("key", "label"), "key")
        alt = alt.groupBy(F.col("alt").alias("key")).agg(F.min("label").alias("alt_label"))
        labelled = materialize(labelled.join(alt, "key", "left").select("key", F.least("label", F.coalesce("alt_label", "label")).alias("label"), "seen", "was"), "settled")
        # labels of earlier versions that turn out to be one message
        links = labelled.filter("was is not null and was <> label").select(F.col("was").alias("old"), F.col("label").alias("new")).distinct()
        links.write.mode("overwrite").parquet(f"{at}/links")
        rows.select("key", "delivery_id").write.mode("overwrite").parquet(f"{at}/out")
        labelled.filter("key not like 'm:%'").select("key", "label").write.mode("overwrite").parquet(f"{at}/first")
        newest = self.store.meta(last[0])["newest"] if last else None
        top = labelled.agg(F.max(F.unix_micros("seen"))).first()[0]
        newest = max((x for x in (newest, top) if x is not None), default=None)
        state = labelled.select("key", "label", "seen")
        if hot is not None:
            state = state.unionByName(hot.join(labelled.select("key"), "key", "left_anti"))
        edge = F.unix_micros("seen") < F.lit((newest or 0) - self.delay_s * 1_000_000)
        state.filter(~F.coalesce(edge, F.lit(True))).write.mode("overwrite").parquet(f"{at}/hot")
        cold_rows = state.filter(F.coalesce(edge, F.lit(True)))
        # every few versions the cold parts become one, so a lookup reads few files whatever the stream's age
        parts = [v for v in done if self.store.has(v, "cold")]
        replaced = parts if len(parts) >= self.compact else []
        if replaced:
            cold_rows = cold_rows.unionByName(self.store.read("cold", replaced, STATE)).groupBy("key").agg(F.min("label").alias("label"), F.max("seen").alias("seen"))
        cold_rows.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{at}/cold")
        self.store.mark(version, {"newest": newest})
        for v in last:
            self.store.drop(v, "hot")
        if replaced:
            for v in replaced:
                self.store.drop(v, "cold")


def first_deliveries(store: SeenStore) -> DataFrame:
    """``first_id, delivery_id`` of every delivery that the store's batches took in."""
    done = store.committed()
    out, first = store.read("out", done, OUTPUT), store.read("first", done, ALIAS)
    first = first.groupBy("key").agg(F.min("label").alias("label"))
    links = store.read("links", done, "old bigint, new bigint")
    if not links.isEmpty():
        # labels that later batches merged; a graph of merges only, settled like the identifiers
        as_key = lambda c: F.col(c).cast("string")
        pairs = links.select(as_key("old").alias("a"), F.concat(F.lit("n:"), as_key("new")).alias("b"), F.least("old", "new").alias("label"))
        pairs = pairs.unionByName(links.select(as_key("new").alias("a"), F.concat(F.lit("n:"), as_key("new")).alias("b"), F.col("new").alias("label")))
        merged = component_labels(pairs.groupBy("a", "b").agg(F.min("label").alias("label")))
        merged = merged.select(F.col("a").cast("long").alias("label"), F.col("label").alias("to"))
        first = first.join(merged, "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    return out.join(first, "key").select(F.col("label").alias("first_id"), "delivery_id")


def deduplicate(spark: SparkSession, path: str, schema=None, *, delay_s: int = 7 * 86400, files_per_batch: int = 512, compact: int = 8, root: str | None = None) -> SeenStore:
    """Take in all deliveries that are new below *path* (parquet) and return the store.

    *delay_s*: how long behind the newest event time an identifier stays in the hot state. *files_per_batch* bounds a
    micro-batch by the files of the source; every *compact* versions the expired identifiers become one table. *root*: the store's and the stream's folder in the shared folder; a later
    call with the same root goes on where the last one ended, and after a failure repeats the batch that was under way.

    Any column may be null; empty input gives an empty store; further columns of the source are ignored.
    """
    root = root or scratch(spark, "dedup")
    store = SeenStore(spark, f"{root}/seen")
    schema = schema or "delivery_id bigint, delivered_at timestamp, source string, source_uid string, thread_id string"
    at = store._p(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream's source is a folder or a pattern
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = stream.writeStream.foreachBatch(SeenMessages(store, delay_s, compact)).option("checkpointLocation", f"{root}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return store


def repeats(first: DataFrame) -> DataFrame:
    """The deliveries of :func:`first_deliveries` that repeat a message."""
    return first.filter("first_id <> delivery_id")
