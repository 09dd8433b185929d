"""Changes of stored tables as plans: upserts, conditional updates and deletions over immutable files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """*stored* with the rows of *new* in place of those of equal key; columns in *keep* stay as first stored.

    A key that *new* holds several times keeps the greatest row; rows without key are never replaced.
    """
    names = stored.columns
    fresh = new.select(*names).groupBy(key).agg(F.max(F.struct(*[n for n in names if n != key])).alias("_n")).select(key, *[F.col(f"_n.{n}").alias(n) for n in names if n != key])
    if keep:
        first = stored.groupBy(key).agg(*[F.min(c).alias(f"_{c}") for c in keep])
        fresh = fresh.join(first, key, "left").select(*[F.coalesce(f"_{n}", n).alias(n) if n in keep else F.col(n) for n in names])
    return stored.join(fresh.select(key), key, "left_anti").select(*names).unionByName(fresh)


def changed(stored: DataFrame, new: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """The rows of *new* whose *columns* differ from the stored ones of their key, NULL being a value like others."""
    old = stored.select(key, F.struct(*columns).alias("_old"))
    return new.join(old, key).filter(~F.struct(*[F.col(c) for c in columns]).eqNullSafe(F.col("_old"))).drop("_old")


def set_vectors(stored: DataFrame, vectors: DataFrame, digest: str) -> DataFrame:
    """Write ``vector`` of ``id, embedded_text, vector`` where the row is still of the policy *digest* and of the text
    that was embedded; other rows stay as they are."""
    fresh = vectors.select("id", F.col("embedded_text").alias("_text"), F.col("vector").alias("_vector"))
    holds = (F.col("policy_hash") == digest) & F.col("one_line").eqNullSafe(F.col("_text")) & F.col("_vector").isNotNull()
    out = stored.join(fresh, "id", "left").withColumn("_holds", F.coalesce(holds, F.lit(False)))
    out = out.withColumns({"summary_embedding": F.when(F.col("_holds"), F.col("_vector")).otherwise(F.col("summary_embedding")), "embedded_policy_hash": F.when(F.col("_holds"), F.lit(digest)).otherwise(F.col("embedded_policy_hash"))})
    return out.select(*stored.columns)


def delete(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def stratified(rows: DataFrame, stratum: str, key: str, size: int) -> DataFrame:
    """*size* rows, round robin over the strata, within one in the order of the key's hash: a sampling operator.

    Each of 64 parts of a stratum is cut to *size* first, so that a hot one is never ordered by one task as a whole.
    """
    rank = F.sha2(F.col(key).cast("string"), 256)
    ranked = rows.withColumn("_h", rank).withColumn("_rn", F.row_number().over(Window.partitionBy(stratum, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("_h", key))).filter(F.col("_rn") <= size)
    ranked = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key)))
    return ranked.orderBy("_rn", stratum, "_h").limit(size).drop("_h", "_rn")
