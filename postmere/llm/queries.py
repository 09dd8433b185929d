"""Queries of the operators for large text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmere.llm import encoding, leakage, mixing, pii, quoting, spam
from postmere.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "records")).select("delivery_id", "field")


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The records' three text fields as they were before wrong decoding."""
    rows = table(spark, d, "records").select("delivery_id", *encoding.FIELDS)
    found = encoding.find_garbled(table(spark, d, "records"))
    fixes = found.groupBy("delivery_id").agg(*[F.any_value(F.when(F.col("field") == f, F.col("fixes")), True).alias(f"_{f}") for f in encoding.FIELDS])
    both = rows.join(fixes, "delivery_id", "left")
    return both.select("delivery_id", *[F.when(F.col(f"_{f}").isNull(), F.col(f)).otherwise(encoding.repaired(F.col(f), F.col(f"_{f}"))).alias(f) for f in encoding.FIELDS])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quoting.find_old_lines(table(spark, d, "records"))


def p2_new_text(spark: SparkSession, d: str) -> DataFrame:
    return quoting.new_text(table(spark, d, "records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(table(spark, d, "records"), table(spark, d, "messages"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with a placeholder of its type for each item."""
    return pii.find_personal(table(spark, d, "records"), table(spark, d, "messages"), with_text=True)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, the documents that hold them and the longest stretch found."""
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.score_pages(table(spark, d, "documents")).filter("is_spam").select("doc_id")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Pages and spam pages by the language of their function words."""
    return spam.score_pages(table(spark, d, "documents")).groupBy("lang").agg(F.count("*").alias("pages"), F.count_if("is_spam").alias("spam"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_new_text, p3_found, p3_redacted, p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_languages)}
ORACLES: dict[str, str] = {}
