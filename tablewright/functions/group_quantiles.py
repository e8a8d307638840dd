"""Exact quantiles of many groups at once, however large a group is.

`percentile ... GROUP BY` keeps all distinct values of a group in one buffer, which a group with
a third of the table does not survive. Here values are counted first (a frequent one is
a row per task), and the counts are dealt into ranges of (group, column, value). A large
group spans many ranges; running counts inside a range and sums of the ranges before it
give every value its ranks, and only the values at the wanted ranks are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import double, quoted
from .storage import materialise


def group_quantiles(df: DataFrame, group: str, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(segment, column_name, n, quantiles) for every value of `group` and column with values:
    linearly interpolated quantiles, in the order of `probabilities`. Rows without a
    group are left out. One row per group and column, none of them on the driver."""
    cells = ", ".join(f"named_struct('i', {i}, 'v', nanvl(CAST({quoted(c)} AS DOUBLE), CAST(NULL AS DOUBLE)))" for i, c in enumerate(columns))
    values = df.where(f"{quoted(group)} IS NOT NULL").selectExpr(f"{quoted(group)} AS segment", f"inline(array({cells}))")
    # -0.0 and 0.0 are one value to a grouping
    counts = values.where("v IS NOT NULL").groupBy("segment", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("segment", "i", "v").withColumn("part", F.spark_partition_id())
    placed = materialise(ranged)  # ranges must be the same for the sums and the rows

    parts = placed.groupBy("segment", "i", "part").agg(F.sum("n").alias("rows"))
    whole = Window.partitionBy("segment", "i")  # at most a row per range
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "segment", "i", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("total")
    )
    inside = Window.partitionBy("segment", "i", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("upto", F.sum("n").over(inside)).join(parts, ["segment", "i", "part"])
    running = running.withColumn("upto", F.col("upto") + F.col("before")).withColumn("since", F.col("upto") - F.col("n"))

    found, quantiles = [], []
    for k, p in enumerate(probabilities):
        position = f"((total - 1) * {double(p)})"
        for side, rank in (("low", f"floor({position})"), ("high", f"ceil({position})")):
            found.append(F.expr(f"max(CASE WHEN upto > {rank} AND since <= {rank} THEN v END)").alias(f"{side}{k}"))
        quantiles.append(f"low{k} + (high{k} - low{k}) * ({position} - floor({position}))")
    rows = running.groupBy("segment", "i").agg(F.max("total").alias("total"), *found)
    label = F.array(*[F.lit(c) for c in columns])[F.col("i")]
    return rows.select(
        "segment", label.alias("column_name"), F.col("total").alias("n"), F.expr(f"array({', '.join(quantiles)})").alias("quantiles")
    )
