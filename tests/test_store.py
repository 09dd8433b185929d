from pyspark.sql import functions as F

from postmere.operators import store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_keeps_first_times(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 11), (None, 1, 1)], "id string, v int, at int")
    new = spark.createDataFrame([("a", 2, 20), ("c", 2, 21), ("c", 1, 5)], "id string, v int, at int")
    got = {tuple(r) for r in store.upsert(old, new, keep=("at",)).collect()}
    assert got == {("a", 2, 10), ("b", 1, 11), ("c", 2, 21), (None, 1, 1)}
    assert rows(store.upsert(old.limit(0), new)) == [("a", 2, 20), ("c", 2, 21)]


def test_changed_compares_nulls(spark):
    old = spark.createDataFrame([("a", None), ("b", 1), ("c", 2)], "id string, v int")
    new = spark.createDataFrame([("a", None), ("b", None), ("c", 3), ("d", 1)], "id string, v int")
    assert rows(store.changed(old, new, ["v"]).select("id")) == [("b",), ("c",)]


def test_vectors_only_for_current_text(spark):
    cols = "id string, one_line string, policy_hash string, summary_embedding array<float>, embedded_policy_hash string"
    old = spark.createDataFrame([("a", "x", "p", None, None), ("b", "new", "p", None, "o"), ("c", "x", "o", None, None)], cols)
    vec = spark.createDataFrame([(i, "x", [1.0]) for i in "abc"], "id string, embedded_text string, vector array<float>")
    got = {r["id"]: (r["summary_embedding"], r["embedded_policy_hash"]) for r in store.set_vectors(old, vec, "p").collect()}
    assert got == {"a": ([1.0], "p"), "b": (None, "o"), "c": (None, None)}


def test_delete_and_stratified(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 90, "big").otherwise("small").alias("s"))
    assert store.delete(df, spark.range(10).select("id")).count() == 90
    got = store.stratified(df, "s", "id", 20).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"big": 10, "small": 10}
