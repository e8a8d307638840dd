"""The facts of an executive summary: best segment, peak months, trend, top place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, data_types, is_category, is_numeric, is_temporal, name_has, nan_to_null
from ..functions.frequencies import small_value_sets


@dataclass(frozen=True)
class StoryColumns:
    metric: str | None
    category: str | None
    date: str | None
    place: str | None


def story_columns(df: DataFrame, row_id: str | None = None) -> StoryColumns:
    """The columns a story is told about."""
    df = nan_to_null(df)
    types = data_types(df, row_id)
    least, most = fv.STORY_SEGMENTS
    numbers = [n for n, t in types.items() if is_numeric(t)]
    categories = [n for n, t in types.items() if is_category(t)]
    small = small_value_sets(df, [*numbers, *categories], most)
    numbers = [n for n in numbers if n not in small or len(small[n]) > 2]
    named = [n for n in numbers if name_has(n, fv.STORY_METRIC_WORDS)]
    fitting = [n for n in categories if len(small.get(n, [])) >= least]
    dates = [n for n, t in types.items() if is_temporal(t)]
    places = [n for n in types if name_has(n, fv.STORY_GEO_WORDS)]

    def first(names):
        return names[0] if names else None

    return StoryColumns(first(named or numbers), first(fitting), first(dates), first(places))


def _totals(df: DataFrame, key: Column, metric: str) -> DataFrame:
    df = nan_to_null(df).select(key.alias("label"), col(metric).alias("x")).where(F.col("label").isNotNull())
    return df.groupBy("label").agg(F.coalesce(F.sum("x"), F.lit(0)).alias("value"))


def _best_and_worst(totals: DataFrame) -> DataFrame:
    """One row from any number of groups; ties follow the label."""
    return totals.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("value").alias("total"),
        F.min(F.struct((-F.col("value")).alias("less"), "label", "value")).alias("best"),
        F.min(F.struct("value", "label")).alias("worst"),
    ).where("groups > 0")


def segment_story(df: DataFrame, metric: str, category: str) -> DataFrame:
    """Best segment with its share, and the worst one when the total is positive."""
    positive = F.col("total") > 0
    return _best_and_worst(_totals(df, col(category), metric)).select(
        F.col("best.label").alias("best"),
        F.col("best.value").alias("best_value"),
        F.when(positive, F.col("best.value") / F.col("total") * 100.0).alias("best_share"),
        F.when(positive, F.col("worst.label")).alias("worst"),
        F.when(positive, F.col("worst.value")).alias("worst_value"),
    )


def _monthly(df: DataFrame, date: str, metric: str) -> DataFrame:
    return _totals(df, F.trunc(col(date), "month"), metric)


def _month_name(month: Column) -> Column:
    return F.date_format(month, "MMMM yyyy")


def peak_trough_month(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Best and worst month; no row for fewer than two months."""
    return (
        _best_and_worst(_monthly(df, date, metric))
        .where("groups >= 2")
        .select(
            _month_name(F.col("best.label")).alias("best_month"),
            F.col("best.value").alias("best_value"),
            _month_name(F.col("worst.label")).alias("worst_month"),
            F.col("worst.value").alias("worst_value"),
        )
    )


def half_trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    """First half of the months against the rest; one row per month is ordered."""
    months = _monthly(df, date, metric)
    placed = months.withColumn("n", F.row_number().over(Window.orderBy("label"))).withColumn(
        "half", F.floor(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) / 2)
    )
    early = F.col("n") <= F.col("half")
    sums = placed.agg(
        F.count(F.lit(1)).alias("months"),
        F.sum(F.when(early, F.col("value")).otherwise(0)).alias("first_half"),
        F.sum(F.when(early, 0).otherwise(F.col("value"))).alias("second_half"),
    ).where("months >= 2")
    trend = (
        F.when(F.col("second_half") > F.col("first_half"), "up")
        .when(F.col("second_half") < F.col("first_half"), "down")
        .otherwise("none")
    )
    return sums.select("first_half", "second_half", trend.alias("trend"))


def top_geo(df: DataFrame, metric: str, place: str) -> DataFrame:
    """The place with the highest total."""
    return _best_and_worst(_totals(df, col(place), metric)).select(
        F.col("best.label").alias("place"), F.col("best.value").alias("value")
    )


def data_insights(
    df: DataFrame, row_id: str | None = None, columns: StoryColumns | None = None
) -> DataFrame:
    """(position, kind, label, value, share) of all facts, ten at most."""
    df = nan_to_null(df)
    c = story_columns(df, row_id) if columns is None else columns
    parts = []

    def fact(position, kind, label, value, share=None):
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(kind).alias("kind"),
            label.cast("string").alias("label"),
            value.cast("double").alias("value"),
            (F.lit(None) if share is None else share).cast("double").alias("share"),
        )

    def add(frame, *facts):
        parts.append(frame.select(F.inline(F.array(*facts))))

    x = F.col
    if c.metric and c.category:
        add(
            segment_story(df, c.metric, c.category),
            fact(0, "best segment", x("best"), x("best_value"), x("best_share")),
            fact(1, "worst segment", x("worst"), x("worst_value")),
        )
    if c.metric and c.date:
        add(
            peak_trough_month(df, c.date, c.metric),
            fact(2, "best month", x("best_month"), x("best_value")),
            fact(3, "worst month", x("worst_month"), x("worst_value")),
        )
        add(
            half_trend(df, c.date, c.metric).where("trend != 'none'"),
            fact(4, "trend", x("trend"), x("second_half") - x("first_half")),
        )
    if c.metric and c.place:
        add(top_geo(df, c.metric, c.place), fact(5, "top place", x("place"), x("value")))
    schema = "position int, kind string, label string, value double, share double"
    result = parts[0] if parts else df.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.where("label IS NOT NULL").orderBy("position").limit(fv.MAX_INSIGHTS)
