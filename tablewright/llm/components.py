"""Connected components of a link table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of `edges` (a, b): the smallest id that links reach.

    Each round keeps only the links whose ends still differ, with each end replaced by
    its present label, so the table shrinks quickly. Every label then moves to the
    smallest label beside it, followed three times. Labels are ids of the same
    component and never grow; the smallest id keeps itself, so when no link is left
    all members hold it. Links of a hot id combine before the shuffle.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    edges = written(edges.distinct())
    ids = edges.select("a").union(edges.select("b")).distinct()
    labels = ids.select(F.col("a").alias("id"), F.col("a").alias("component"))
    left = edges
    while not left.isEmpty():
        both = left.select(F.col("b").alias("label"), F.col("a").alias("to"))
        parent = written(both.groupBy("label").agg(F.min("to").alias("to")))
        for _ in range(3):
            up = parent.select(F.col("label").alias("to"), F.col("to").alias("top"))
            parent = parent.join(up, "to", "left").select("label", F.coalesce("top", "to").alias("to"))
        parent = written(parent)
        labels = written(
            labels.join(parent.withColumnRenamed("label", "component"), "component", "left").select(
                "id", F.coalesce("to", "component").alias("component")
            )
        )
        for end in ("a", "b"):
            moved = parent.select(F.col("label").alias(end), "to")
            left = left.join(moved, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = written(
            left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
    return labels
