"""Why did a number move? Totals, months, segments and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import as_text, col, data_types, is_category, is_numeric, is_temporal, nan_to_null, per_column
from .ask import group_by_month
from .recommend import correlation


def overall_stats(df: DataFrame, target: str) -> DataFrame:
    """Total, mean and number of rows."""
    return nan_to_null(df).agg(
        F.coalesce(F.sum(col(target)), F.lit(0)).alias("total"),
        F.avg(col(target)).alias("average"),
        F.count(F.lit(1)).alias("row_count"),
    )


def monthly_trend(df: DataFrame, date: str, target: str) -> DataFrame:
    """Last month against the one before, and the best and worst month.

    No row when there are fewer than two months. The monthly table has one row
    per calendar month, so one task may put it in order.
    """
    months = group_by_month(df, date, target).select(col(date).alias("month"), col(target).alias("value"))
    order = Window.orderBy("month")
    steps = months.select(
        "month",
        "value",
        F.lag("month").over(order).alias("previous_month"),
        F.lag("value").over(order).alias("previous_value"),
    )
    first_best = F.struct((-F.col("value")).alias("less"), "month", "value")
    first_worst = F.struct("value", "month")
    summary = steps.agg(
        F.count(F.lit(1)).alias("months"),
        F.max(F.struct("month", "value", "previous_month", "previous_value")).alias("last"),
        F.min(first_best).alias("best"),
        F.min(first_worst).alias("worst"),
    ).where("months >= 2")
    change = F.coalesce(
        F.try_divide(F.col("last.value") - F.col("last.previous_value"), F.col("last.previous_value")) * 100.0,
        F.lit(0.0),
    )
    return summary.select(
        F.col("last.previous_month").alias("previous_month"),
        F.col("last.month").alias("last_month"),
        change.alias("change_percent"),
        F.when(change > 0, "increased").otherwise("decreased").alias("direction"),
        F.col("best.month").alias("best_month"),
        F.col("best.value").alias("best_value"),
        F.col("worst.month").alias("worst_month"),
        F.col("worst.value").alias("worst_value"),
    )


def segment_totals(df: DataFrame, target: str, categories: Sequence[str]) -> DataFrame:
    """(category, segment, total, average, row_count) for several columns in one grouping."""
    df = nan_to_null(df)
    types = data_types(df)
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("category"), as_text(n, types[n]).alias("segment"))
                    for n in categories
                ]
            )
        ).alias("s"),
        col(target).alias("x"),
    ).where(F.col("s.segment").isNotNull())
    return cells.groupBy("s.category", "s.segment").agg(
        F.coalesce(F.sum("x"), F.lit(0)).alias("total"),
        F.avg("x").alias("average"),
        F.count("x").alias("row_count"),
    )


def category_columns(df: DataFrame, row_id: str | None = None) -> list[str]:
    return [n for n, t in data_types(df, row_id).items() if is_category(t)]


def segment_breakdown(
    df: DataFrame, target: str, categories: Sequence[str] | None = None, row_id: str | None = None
) -> DataFrame:
    """Per category: leader with share and average, laggard, gap between them.

    Leader and laggard are aggregates over the segments, so a column with many
    segments is never gathered in one task. Ties follow the segment's name.
    """
    names = category_columns(df, row_id) if categories is None else list(categories)
    if not names:
        return df.sparkSession.createDataFrame(
            [],
            "category string, segments long, leader string, leader_total double, leader_average double, "
            "leader_share double, laggard string, laggard_total double, gap double",
        )
    best = F.struct((-F.col("total")).alias("less"), "segment", "total", "average")
    worst = F.struct("total", "segment")
    summary = (
        segment_totals(df, target, names)
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("segments"),
            F.sum("total").alias("grand"),
            F.min(best).alias("best"),
            F.min(worst).alias("worst"),
        )
    )
    share = F.when(F.col("grand") > 0, F.col("best.total") / F.col("grand") * 100.0).otherwise(0.0)
    return summary.select(
        "category",
        "segments",
        F.col("best.segment").alias("leader"),
        F.col("best.total").alias("leader_total"),
        F.col("best.average").alias("leader_average"),
        share.alias("leader_share"),
        F.col("worst.segment").alias("laggard"),
        F.col("worst.total").alias("laggard_total"),
        F.when(F.col("segments") >= 2, F.col("best.total") - F.col("worst.total")).alias("gap"),
    )


def correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None, row_id: str | None = None) -> DataFrame:
    """(ordinal, column_name, correlation) of every other numeric column with the target."""
    df = nan_to_null(df)
    names = [
        n
        for n, t in data_types(df, row_id).items()
        if is_numeric(t) and n != target and (columns is None or n in columns)
    ]
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column_name string, correlation double")
    y = col(target).cast("double")
    frame = df.agg(*[correlation(y, col(n).cast("double")).alias(f"r{i}") for i, n in enumerate(names)])
    entries = [
        [F.lit(i).alias("ordinal"), F.lit(n).alias("column_name"), F.col(f"r{i}").alias("correlation")]
        for i, n in enumerate(names)
    ]
    return per_column(frame, entries).where("correlation IS NOT NULL")


def top_correlation(df: DataFrame, target: str, row_id: str | None = None) -> DataFrame:
    """The strongest correlation with the target, its strength and direction."""
    size = F.abs("correlation")
    strength = (
        F.when(size > fv.STRONG_CORRELATION, "strong")
        .when(size > fv.MODERATE_CORRELATION, "moderate")
        .otherwise("weak")
    )
    return (
        correlations(df, target, row_id=row_id)
        .orderBy(size.desc(), "ordinal")
        .limit(1)
        .select(
            "column_name",
            "correlation",
            strength.alias("strength"),
            F.when(F.col("correlation") > 0, "positive").otherwise("negative").alias("direction"),
        )
    )


def diagnose(df: DataFrame, target: str, row_id: str | None = None) -> DataFrame:
    """All of the above as (position, section, item, label, value) rows."""
    types = data_types(df, row_id)

    def row(position, section, item, label, value):
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(section).alias("section"),
            F.lit(item).alias("item") if isinstance(item, str) else item.alias("item"),
            (F.lit(None) if label is None else label).cast("string").alias("label"),
            value.cast("double").alias("value"),
        )

    def c(name):
        return F.col(name)

    overall = overall_stats(df, target).select(
        F.inline(
            F.array(
                row(0, "overall", "total", None, c("total")),
                row(0, "overall", "average", None, c("average")),
                row(0, "overall", "rows", None, c("row_count")),
            )
        )
    )
    parts = [overall]
    dates = [n for n, t in types.items() if is_temporal(t)]
    if dates:
        parts.append(
            monthly_trend(df, dates[0], target).select(
                F.inline(
                    F.array(
                        row(1, "trend", "last month", c("last_month"), c("change_percent")),
                        row(1, "trend", "best month", c("best_month"), c("best_value")),
                        row(1, "trend", "worst month", c("worst_month"), c("worst_value")),
                    )
                )
            )
        )
    names = category_columns(df, row_id)
    if names:
        order = F.element_at(
            F.create_map(*[x for i, n in enumerate(names, start=2) for x in (F.lit(n), F.lit(i))]), c("category")
        )
        lines = segment_breakdown(df, target, names).withColumn("at", order)
        parts.append(
            lines.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                c("at").alias("position"),
                                c("category").alias("section"),
                                F.lit(item).alias("item"),
                                label.cast("string").alias("label"),
                                value.cast("double").alias("value"),
                            )
                            for item, label, value in (
                                ("leader", c("leader"), c("leader_total")),
                                ("leader share", c("leader"), c("leader_share")),
                                ("laggard", c("laggard"), c("laggard_total")),
                                ("gap", F.lit(None), c("gap")),
                            )
                        ]
                    )
                )
            )
        )
    strongest = top_correlation(df, target, row_id).select(
        F.lit(len(names) + 2).alias("position"),
        F.lit("correlation").alias("section"),
        F.concat_ws(" ", "strength", "direction").alias("item"),
        F.col("column_name").alias("label"),
        F.col("correlation").alias("value"),
    )
    result = parts[0]
    for part in [*parts[1:], strongest]:
        result = result.unionByName(part)
    return result.orderBy("position")
