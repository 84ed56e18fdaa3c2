"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) for each node of edges a, b; nodes without edges have no row.

    Each round takes the lowest label among a node and its neighbours, then the label of that label. Labels are aggregated
    in part before they are shuffled; both sides of the joins are written tables, so that Spark splits the edges of a node
    that has very many. The rounds end when nothing changes. Repeated edges count once.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("low"))
        jump = low.join(labels.select(F.col("node").alias("low"), F.col("component").alias("lower")), "low")
        after = materialize(jump.select("node", F.col("component").alias("_was"), F.least("low", "lower").alias("component")), "labels")
        changed = after.where("component <> _was").limit(1).count()
        drop(labels)
        labels = after.select("node", "component")
        if not changed:
            return labels
