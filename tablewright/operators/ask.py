"""Answers over a table: totals, groups, rankings, months, charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, data_types, is_temporal, nan_to_null

COUNT = "Count"
_OPERATIONS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "count": F.count,
}


def operation(op: str | None, column: Column) -> Column:
    """An aggregate by name; unknown names mean sum. An empty sum is 0."""
    return _OPERATIONS.get(op or "sum", _OPERATIONS["sum"])(column)


def aggregate(df: DataFrame, column: str, op: str | None = "sum") -> DataFrame:
    """One number over a column, missing values left out."""
    return nan_to_null(df).agg(operation(op, col(column)).alias("value"))


def month_of(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def group_aggregate(
    df: DataFrame,
    group: str,
    column: str | None = None,
    op: str | None = "sum",
    sort: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(group, value) per group; dates group by month, missing groups are left out.

    Without a column, or to count, the value is the number of rows and is named
    Count. Ranking with a limit keeps the first rows of each task before the
    final merge; ties follow the group.
    """
    df = nan_to_null(df).where(col(group).isNotNull())
    key = month_of(col(group)) if is_temporal(data_types(df)[group]) else col(group)
    if column is None or op == "count":
        name, value = COUNT, F.count(F.lit(1))
    else:
        name, value = column, operation(op, col(column))
    result = df.groupBy(key.alias(group)).agg(value.alias(name))
    if sort == "desc":
        result = result.orderBy(col(name).desc_nulls_last(), col(group))
    elif sort == "asc":
        result = result.orderBy(col(name).asc_nulls_last(), col(group))
    else:
        result = result.orderBy(col(group))
    return result if limit is None else result.limit(limit)


def group_by_month(df: DataFrame, date: str, column: str | None = None, op: str | None = "sum") -> DataFrame:
    """`group_aggregate` over the months of a date column."""
    return group_aggregate(df, date, column, op)


def top_n(df: DataFrame, group: str, column: str | None, n: int, op: str | None = "sum") -> DataFrame:
    return group_aggregate(df, group, column, op, "desc", n)


def bottom_n(df: DataFrame, group: str, column: str | None, n: int, op: str | None = "sum") -> DataFrame:
    return group_aggregate(df, group, column, op, "asc", n)


def chart_series(
    df: DataFrame,
    group: str,
    column: str | None = None,
    op: str | None = "sum",
    chart: str = "bar",
    sort: str | None = None,
) -> DataFrame:
    """(label, value[, share]) as drawn: 15 bars, all line points, 6 slices."""
    name = COUNT if column is None or op == "count" else column
    rows = {"bar": fv.BAR_ROWS, "pie": fv.PIE_ROWS, "line": None}[chart]
    order = None if chart == "line" else sort
    series = group_aggregate(df, group, column, op, order, rows).select(
        col(group).cast("string").alias("label"), col(name).alias("value")
    )
    if chart != "pie":
        return series
    # shares of the six drawn slices
    drawn = Window.partitionBy(F.lit(0))
    return series.withColumn("share", F.try_divide(F.col("value") * 100.0, F.sum("value").over(drawn)))
