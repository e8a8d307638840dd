"""Headline numbers and charts that fit a table, and the data behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, data_types, name_has, nan_to_null, per_column
from ..functions.cross_products import correlations_of
from ..functions.frequencies import distinct_counts, small_value_sets
from .roles import CATEGORICAL, DATE, IDENTIFIER, NUMERICAL, infer_roles, with_role


def kpi_cards(df: DataFrame, row_id: str | None = None, roles: dict[str, str] | None = None) -> DataFrame:
    """Up to four cards: (position, name, value, unit)."""
    df = nan_to_null(df)
    roles = infer_roles(df, row_id) if roles is None else roles
    cards: list[tuple[str, Column, str, Column]] = []  # name, value, unit, condition
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(with_role(roles, NUMERICAL)):
        x = col(n).cast("double")
        shown = F.col(f"n{i}") > 0
        total = (f"Total {n}", F.col(f"s{i}"), "total", shown)
        average = (f"Average {n}", F.col(f"a{i}"), "average", shown)
        if name_has(n, fv.MONEY_CARD_WORDS):
            cards += [total, average]
        elif name_has(n, fv.PROFIT_CARD_WORDS):
            cards.append(total)
        elif name_has(n, fv.RATING_CARD_WORDS):
            cards.append(average)
        else:
            continue
        aggregates += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}"), F.avg(x).alias(f"a{i}")]
    ids = with_role(roles, IDENTIFIER)[: fv.MAX_CARDS]
    if ids:
        unique = distinct_counts(df, ids)
        wide = unique.agg(
            F.struct(
                *[
                    F.coalesce(F.max(F.when(F.col("column_name") == n, F.col("unique_count"))), F.lit(0)).alias(f"u{i}")
                    for i, n in enumerate(ids)
                ]
            ).alias("ids")
        )
    frame = df.agg(*aggregates)
    if ids:
        frame = frame.withColumn("ids", wide.scalar())
    for i, n in enumerate(ids):
        if name_has(n, fv.CUSTOMER_ID_WORDS):
            label = "Total Customers"
        elif name_has(n, fv.ORDER_ID_WORDS):
            label = "Total Orders"
        else:
            label = f"Unique {n} Count"
        cards.append((label, F.col(f"ids.u{i}").cast("double"), "count", F.lit(True)))
    nothing = ~_any_of([c[3] for c in cards])
    cards.append(("Total Records", F.col("rows").cast("double"), "count", nothing))
    cards.append(("Total Columns", F.lit(float(len(roles))), "count", nothing))
    shown = per_column(
        frame,
        [
            [
                F.lit(i).alias("position"),
                F.lit(name).alias("name"),
                value.alias("value"),
                F.lit(unit).alias("unit"),
                condition.alias("shown"),
            ]
            for i, (name, value, unit, condition) in enumerate(cards)
        ],
    )
    return shown.where("shown").drop("shown").orderBy("position").limit(fv.MAX_CARDS)


def _any_of(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def chart_candidates(
    df: DataFrame, row_id: str | None = None, roles: dict[str, str] | None = None
) -> DataFrame:
    """Up to six charts: (position, chart, x_axis, y_axis)."""
    df = nan_to_null(df)
    roles = infer_roles(df, row_id) if roles is None else roles
    dates, numbers = with_role(roles, DATE), with_role(roles, NUMERICAL)
    categories = with_role(roles, CATEGORICAL)
    charts: list[tuple[str, str, str]] = []

    line = [n for n in numbers if name_has(n, fv.LINE_METRIC_WORDS)]
    if dates and line:
        charts.append(("Line Chart", dates[0], line[0]))
    bar = [n for n in numbers if name_has(n, fv.BAR_METRIC_WORDS)]
    if categories and bar:
        charts.append(("Bar Chart", categories[0], bar[0]))
    slices = small_value_sets(df, categories, 6)
    pie = [n for n in categories if 2 <= len(slices.get(n, [])) <= 6]
    if pie:
        charts.append(("Pie Chart", pie[0], "Record Count"))
    if len(numbers) >= 2:
        charts.append(("Scatter Plot", numbers[0], numbers[1]))
    places = [n for n in roles if name_has(n, fv.GEO_CHART_WORDS)]
    if places and numbers:
        charts.append(("Geographic Map", places[0], numbers[0]))
    if len(categories) >= 2 and numbers:
        charts.append(("Stacked Bar Chart", categories[0], f"{numbers[0]} by {categories[1]}"))
    if numbers:
        charts.append(("Histogram", numbers[0], "Frequency"))
    if len(numbers) >= 3:
        charts.append(("Heatmap", "Numerical Columns Matrix", "Correlation Score"))
    if not charts:
        charts.append(("Bar Chart", next(iter(roles)), "Record Count"))
    return df.sparkSession.createDataFrame(
        [(i, *c) for i, c in enumerate(charts[: fv.MAX_CHARTS])],
        "position int, chart string, x_axis string, y_axis string",
    )


def bar_data(df: DataFrame, x: str, y: str) -> DataFrame:
    """(label, value): sum of y per x."""
    df = nan_to_null(df).where(col(x).isNotNull())
    return df.groupBy(col(x).alias("label")).agg(F.coalesce(F.sum(col(y)), F.lit(0)).alias("value"))


def pie_data(df: DataFrame, x: str) -> DataFrame:
    """(label, value): rows per x."""
    df = nan_to_null(df).where(col(x).isNotNull())
    return df.groupBy(col(x).alias("label")).agg(F.count(F.lit(1)).alias("value"))


def stacked_data(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(label, part, value): sum of y per x and by."""
    df = nan_to_null(df).where(col(x).isNotNull() & col(by).isNotNull())
    return df.groupBy(col(x).alias("label"), col(by).alias("part")).agg(
        F.coalesce(F.sum(col(y)), F.lit(0)).alias("value")
    )


def histogram_data(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """(bin, lower, upper, frequency) over equal widths; the last bin is closed."""
    spark = df.sparkSession
    value = col(x).cast("double")
    df = nan_to_null(df).where(value.isNotNull())
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, frequency long")
    if low == high:  # one value: a unit range around it
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((value - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    edges = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("upper"),
    )
    # at most `bins` rows
    return edges.join(F.broadcast(counts), "bin", "left").withColumn(
        "frequency", F.coalesce("frequency", F.lit(0))
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL for a constant side."""
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)


def heatmap_data(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, correlation) for every pair of columns, from one scan whatever their number."""
    df = nan_to_null(df)
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "x string, y string, correlation double")
    found = correlations_of(df, columns)
    names = F.array(*[F.lit(n) for n in columns])
    every = spark.range(len(columns) - 1).select(F.col("id").cast("int").alias("i"))
    every = every.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(len(columns) - 1))).alias("j"))
    return every.join(found, ["i", "j"], "left").select(  # pairs of an empty table are there too
        F.element_at(names, F.col("i") + 1).alias("x"), F.element_at(names, F.col("j") + 1).alias("y"), "correlation"
    )


def scatter_data(
    df: DataFrame, x: str, y: str, fraction: float = 0.05, seed: int = 0, key: Sequence[str] | None = None
) -> DataFrame:
    """A share of the (x, y) points, drawn by a hash of the `key` columns (all columns by
    default): the same points whatever the partitions."""
    names = list(key or data_types(df))
    text = F.concat_ws(":", F.lit(str(seed)), *[col(n).cast("string") for n in names])
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") < F.lit(fraction * 2**32)
    return nan_to_null(df.where(drawn).select(col(x).alias("x"), col(y).alias("y"))).dropna()
