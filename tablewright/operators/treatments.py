"""Treatments a user approves column by column: imputation and outliers."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import ROW_ID, col, data_types, is_fillable, is_numeric, is_text, nan_to_null
from ..functions.frequencies import modes
from ..functions.quantiles import exact_quantiles
from ..functions.storage import materialise
from .cleaning import fill_forward, fill_value, interpolate, replace_columns
from .outliers import segment_bounds

IMPUTATIONS = ["keep_null", "median", "mean", "mode", "ffill", "interpolate", "na_string", "indicator"]
SEGMENT_ACTIONS = ["keep", "remove", "cap", "nullify", "flag"]
OUTLIER_ACTIONS = [*SEGMENT_ACTIONS, "rescale"]
UNIT_FACTORS = (100.0, 1000.0)  # mistaken units, as the cause rule for units looks for them


def fill_constant(df: DataFrame, column: str, action: str) -> object | None:
    """The value an action fills a column with; None when there is none to fill."""
    numeric = is_numeric(data_types(df)[column])
    if action == "median" or (action == "indicator" and numeric):
        return exact_quantiles(df, {column: (0.5,)})[column][0.5]
    if action == "mean":
        return df.agg(F.avg(col(column).cast("double"))).first()[0]
    if action in ("mode", "indicator") and not is_fillable(data_types(df)[column]):
        return None
    if action in ("mode", "indicator"):
        value = modes(df, [column])[column]
        if value is None and action == "indicator" and is_text(data_types(df)[column]):
            return ""
        return value
    if action == "na_string":
        return "N/A"
    return None


def impute_with(
    df: DataFrame, column: str, action: str, value: object | None, row_id: str = ROW_ID
) -> DataFrame:
    """Apply one imputation whose constant is already known; lazy."""
    if action == "ffill":
        return fill_forward(df, [column], row_id)
    if action == "interpolate":
        return interpolate(df, [column], row_id) if is_numeric(data_types(df)[column]) else df
    if action == "na_string":
        df = replace_columns(df, {column: col(column).cast("string")})
    if action == "indicator":
        df = df.withColumn(f"{column}_missing", col(column).isNull().cast("int"))
    return fill_value(df, {column: value})


def impute(df: DataFrame, column: str, action: str, row_id: str = ROW_ID) -> DataFrame:
    """Fill the gaps of one column; a column without gaps stays as it is.

    `keep_null` and unknown actions change nothing, and so does `interpolate` on a column
    that holds no numbers.
    """
    df = nan_to_null(df)
    if df.where(col(column).isNull()).isEmpty():
        return df
    return impute_with(df, column, action, fill_constant(df, column, action), row_id)


@dataclass(frozen=True)
class Bounds:
    lower: float
    upper: float
    median: float | None = None

    def outside(self, column: str) -> Column:
        """True outside the bounds; missing values are never outside."""
        x = col(column).cast("double")
        return F.coalesce((x < F.lit(self.lower)) | (x > F.lit(self.upper)), F.lit(False))


    def factor(self, column: str) -> Column:
        """What a value outside the bounds is too large by: the unit factor nearest to its ratio to
        the median on a scale of logarithms, if the value divided by it lies within the bounds;
        else null."""
        if self.median is None or self.median <= 0:
            return F.lit(None).cast("double")
        x = col(column).cast("double")
        ratio = x / F.lit(self.median)
        nearest = F.lit(None).cast("double")
        for f in UNIT_FACTORS:  # from f / sqrt(10) up to f * sqrt(10)
            near = (ratio * ratio >= F.lit(f * f / 10)) & (ratio * ratio < F.lit(f * f * 10))
            nearest = F.when(near, F.lit(f)).otherwise(nearest)
        scaled = x / nearest
        return F.when(self.outside(column) & (scaled >= F.lit(self.lower)) & (scaled <= F.lit(self.upper)), nearest)

    def concerns(self, column: str, action: str) -> Column:
        """True for the values that an action is about."""
        return self.factor(column).isNotNull() if action == "rescale" else self.outside(column)


def iqr_bounds(
    df: DataFrame, columns: list[str], rows: int | None = None, medians: Collection[str] = ()
) -> dict[str, Bounds | None]:
    """Quartile bounds of several columns in shared passes, with the median of those in `medians`;
    `rows` saves counting them."""
    ranks = {n: (0.25, 0.5, 0.75) if n in medians else (0.25, 0.75) for n in columns}
    found = exact_quantiles(df, ranks, rows=rows)
    result: dict[str, Bounds | None] = {}
    for n, q in found.items():
        if q[0.25] is None:
            result[n] = None
            continue
        reach = fv.IQR_FACTOR * (q[0.75] - q[0.25])
        result[n] = Bounds(q[0.25] - reach, q[0.75] + reach, q.get(0.5))
    return result


def flag_name(df: DataFrame, column: str) -> str:
    """`<column>_outlier`, with as many underscores as keep it apart from the table's columns."""
    name, taken = f"{column}_outlier", {n.lower() for n in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def treat_with(df: DataFrame, column: str, action: str, bounds: Bounds | None) -> DataFrame:
    """Apply one outlier action with known bounds; lazy. Rows with NULL survive."""
    if bounds is None or action == "keep" or action not in OUTLIER_ACTIONS:
        return df
    outside = bounds.outside(column)
    if action == "remove":
        return df.where(~outside)
    if action == "flag":
        return df.withColumn(flag_name(df, column), outside.cast("int"))
    x = col(column).cast("double")
    if action == "rescale":
        return replace_columns(df, {column: x / F.coalesce(bounds.factor(column), F.lit(1.0))})
    if action == "cap":
        capped = F.least(F.greatest(x, F.lit(bounds.lower)), F.lit(bounds.upper))
        return replace_columns(df, {column: F.when(x.isNotNull(), capped)})
    return replace_columns(df, {column: F.when(~outside, col(column))})


def treat_outliers(df: DataFrame, column: str, action: str) -> DataFrame:
    """Keep, remove, cap, nullify or flag the values outside the quartile bounds, or `rescale` those
    that a mistaken unit explains: they are divided by 100 or 1000, others outside stay.

    `flag` adds a column `<column>_outlier` of 0 and 1; no row is lost. Missing values are never outside.
    """
    df = nan_to_null(df)
    medians = [column] if action == "rescale" else []
    return treat_with(df, column, action, iqr_bounds(df, [column], medians=medians)[column])


def treat_by_segment(df: DataFrame, column: str, action: str, by: str) -> DataFrame:
    """Remove, cap, nullify or flag the values outside the bounds of their own segment of `by`. Values
    of rows without a segment, or in segments with too few values, stay."""
    return treat_segments(df, column, action, by, written_bounds(df, column, by))


def written_bounds(df: DataFrame, column: str, by: str) -> DataFrame:
    """(segment, lower, upper) of one column, written once: counting and treating read the same."""
    return materialise(segment_bounds(nan_to_null(df), by, [column]).select("segment", "lower", "upper"))


def segment_outlier_rows(df: DataFrame, column: str, by: str, bounds: DataFrame) -> DataFrame:
    """The values of a column outside the bounds of their segment."""
    rows = df.select(col(by).alias("segment"), col(column).cast("double").alias("value")).join(bounds, "segment")
    return rows.where("value < lower OR value > upper")


def treat_segments(df: DataFrame, column: str, action: str, by: str, bounds: DataFrame) -> DataFrame:
    """`treat_by_segment` with known bounds; lazy."""
    if action == "keep" or action not in SEGMENT_ACTIONS:
        return df
    names = {"segment": "_tw_segment", "lower": "_tw_lower", "upper": "_tw_upper"}
    bounds = bounds.withColumnsRenamed(names)
    joined = nan_to_null(df).join(bounds, col(by) == F.col("_tw_segment"), "left")
    x, low, high = col(column).cast("double"), F.col("_tw_lower"), F.col("_tw_upper")
    outside = F.coalesce((x < low) | (x > high), F.lit(False))
    if action == "flag":
        return joined.select(*[col(n) for n in df.columns], outside.cast("int").alias(flag_name(df, column)))
    if action == "remove":
        joined = joined.where(~outside)
    elif action == "cap":
        capped = F.when(x.isNotNull(), F.when(low.isNull(), x).otherwise(F.least(F.greatest(x, low), high)))
        joined = joined.withColumn(column, capped)
    else:
        joined = joined.withColumn(column, F.when(~outside, col(column)))
    return joined.select(*[col(n) for n in df.columns])
