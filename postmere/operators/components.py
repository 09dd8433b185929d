"""Connected components of a two-sided graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmere.sources.tables import materialize


def component_labels(pairs: DataFrame) -> DataFrame:
    """``a, label`` of ``pairs(a, b, label)``: the smallest label of each ``a``'s component.

    Only what can change takes part: pairs whose ``b`` has one ``a`` connect nothing. Each ``a`` points at a root, at first
    itself. A round sends the smallest root over each ``b`` to the roots of its ``a`` values, hooks those roots below it, and
    lets the hooks jump to their ends' ends until none moves, so a chain of n takes about log n steps.
    All steps are aggregations that combine before the shuffle and joins on single rows, so no group is ever held by one
    task; a hot ``b`` costs one partial row a partition. Labels of ``a`` values outside the returned rows stay as they are.
    """
    shared = pairs.groupBy("b").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo <> hi").select("b")
    edges = materialize(pairs.join(shared, "b", "left_semi").select("a", "b"), "edges")
    if edges.isEmpty():
        return pairs.select("a", "label").limit(0)
    roots = materialize(edges.select("a").distinct().select("a", F.col("a").alias("root")), "roots")
    while True:
        at = edges.join(roots, "a").select("b", "root").distinct()
        low = at.groupBy("b").agg(F.min("root").alias("low"))
        hooks = materialize(at.join(low, "b").filter("low < root").groupBy("root").agg(F.min("low").alias("to")), "hooks")
        if hooks.isEmpty():
            break
        while True:  # where a hook ends may be hooked itself: the hooks jump to their ends' ends until none moves
            hop = hooks.select(F.col("root").alias("to"), F.col("to").alias("end"))
            step = materialize(hooks.join(hop, "to", "left").select("root", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")), "jump")
            hooks = step.select("root", "to")
            if step.filter("moved").isEmpty():
                break
        roots = materialize(roots.join(hooks, "root", "left").select("a", F.coalesce("to", "root").alias("root")), "roots")
    own = pairs.join(roots.select("a"), "a", "left_semi").groupBy("a").agg(F.min("label").alias("label")).join(roots, "a")
    least = own.groupBy("root").agg(F.min("label").alias("label"))
    return materialize(roots.join(least, "root").select("a", "label"), "labels")
