"""Extreme values: four methods, their votes, a summary and likely causes.

`outlier_stats` reads each candidate column a few times (column-pruned, no sort)
and returns plain numbers; everything after that is a filter with literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import (
    ROW_ID,
    col,
    data_types,
    double,
    is_numeric,
    name_has,
    nan_to_null,
    quoted,
    text_literal,
)
from ..functions.group_quantiles import group_quantiles
from ..functions.quantiles import approx_quantiles, exact_quantiles
from ..functions.storage import materialise

METHODS = ["IQR", "Z-Score", "Modified Z-Score", "Percentiles"]
#: Quantiles that a method looks at; the two scores need the moments, and one the deviations.
_NEEDS = {"IQR": (0.25, 0.75), "Z-Score": (), "Modified Z-Score": (0.5,), "Percentiles": (0.01, 0.99)}


@dataclass(frozen=True)
class OutlierStats:
    count: int
    low: float
    high: float
    mean: float
    std: float | None
    p1: float | None
    q1: float | None
    median: float | None
    q3: float | None
    p99: float | None
    mad: float | None

    @property
    def iqr_bounds(self) -> tuple[float, float]:
        reach = fv.IQR_FACTOR * (self.q3 - self.q1)
        return self.q1 - reach, self.q3 + reach

    @property
    def z_bounds(self) -> tuple[float, float]:
        if not self.std:
            return 0.0, 0.0
        return self.mean - fv.Z_LIMIT * self.std, self.mean + fv.Z_LIMIT * self.std


def outlier_columns(df: DataFrame, row_id: str | None = None) -> list[str]:
    """Numeric columns whose name does not look like an identifier."""
    return [
        n
        for n, t in data_types(df, row_id).items()
        if is_numeric(t) and not name_has(n, fv.OUTLIER_SKIP_WORDS)
    ]


def outlier_stats(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    row_id: str | None = None,
    approx: bool = False,
    methods: Sequence[str] = METHODS,
) -> dict[str, OutlierStats]:
    """Location, spread and quantiles of each candidate with at least 5 values; of the
    quantiles only those that `methods` look at, the others are None."""
    df = nan_to_null(df)
    names = outlier_columns(df, row_id) if columns is None else list(columns)
    if not names:
        return {}
    moments = df.selectExpr(
        *[
            f"{f}(CAST({quoted(n)} AS DOUBLE)) AS {f}{i}"
            for i, n in enumerate(names)
            for f in ("count", "min", "max", "avg", "stddev_samp")
        ]
    ).first()
    numbers = {n: i for i, n in enumerate(names) if moments[f"count{i}"] >= fv.OUTLIER_MIN_VALUES}
    most = max((moments[f"count{i}"] for i in range(len(names))), default=0)
    quantiles = approx_quantiles if approx else partial(exact_quantiles, rows=most)
    wanted = tuple(sorted({p for m in methods for p in _NEEDS[m]}))
    found = quantiles(df, {n: wanted for n in numbers}) if wanted and numbers else {n: {} for n in numbers}
    spread: dict[str, dict[float, float | None]] = {}
    if "Modified Z-Score" in methods and numbers:
        distance = df.selectExpr(
            *[f"abs(CAST({quoted(n)} AS DOUBLE) - {double(found[n][0.5])}) AS d{i}" for n, i in numbers.items()]
        )
        spread = quantiles(distance, {f"d{i}": (0.5,) for i in numbers.values()})
    return {
        n: OutlierStats(
            *[moments[f"{f}{i}"] for f in ("count", "min", "max", "avg", "stddev_samp")],
            *[found[n].get(p) for p in (0.01, 0.25, 0.5, 0.75, 0.99)],
            spread.get(f"d{i}", {}).get(0.5),
        )
        for n, i in numbers.items()
    }


def _outside(x: str, low: float, high: float) -> str:
    return f"({x} < {double(low)} OR {x} > {double(high)})"


def flags(name: str, s: OutlierStats, methods: Sequence[str] = METHODS) -> dict[str, str]:
    """Method -> SQL condition on the column; a missing value is never an outlier."""
    x = f"CAST({quoted(name)} AS DOUBLE)"
    zscore = f"abs(({x} - {double(s.mean)}) / {double(s.std)}) > {double(fv.Z_LIMIT)}" if s.std else "false"

    def test(method: str) -> str:
        if method == "IQR":
            return _outside(x, *s.iqr_bounds)
        if method == "Percentiles":
            return _outside(x, s.p1, s.p99)
        if method == "Modified Z-Score" and s.mad:
            scaled = f"{double(fv.MODIFIED_Z_FACTOR)} * ({x} - {double(s.median)}) / {double(s.mad)}"
            return f"abs({scaled}) > {double(fv.MODIFIED_Z_LIMIT)}"
        return zscore

    return {method: f"coalesce({test(method)}, false)" for method in methods}


def any_flag(name: str, s: OutlierStats) -> str:
    return "(" + " OR ".join(flags(name, s).values()) + ")"


def _flagged(df: DataFrame, column: str, method: str, row_id: str) -> DataFrame:
    df = nan_to_null(df)
    stats = outlier_stats(df, [column], row_id, methods=(method,))
    if column not in stats:
        return df.select(col(row_id), col(column).alias("value")).limit(0)
    return df.where(flags(column, stats[column], (method,))[method]).select(col(row_id), col(column).alias("value"))


def outliers_iqr(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """Rows outside the quartiles by more than 1.5 interquartile ranges."""
    return _flagged(df, column, "IQR", row_id)


def outliers_zscore(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """Rows more than 3 sample deviations from the mean."""
    return _flagged(df, column, "Z-Score", row_id)


def outliers_modified_z(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """Rows with a modified z-score above 3.5; the plain z-score when the MAD is 0."""
    return _flagged(df, column, "Modified Z-Score", row_id)


def outliers_percentile(df: DataFrame, column: str, row_id: str = ROW_ID) -> DataFrame:
    """Rows below the 1st or above the 99th percentile."""
    return _flagged(df, column, "Percentiles", row_id)


def outlier_votes(
    df: DataFrame,
    row_id: str = ROW_ID,
    stats: Mapping[str, OutlierStats] | None = None,
    sample: int = fv.OUTLIER_SAMPLE_ROWS,
) -> DataFrame:
    """The first flagged rows of each column with the methods that agree.

    `row_number() <= sample` is cut in every task before the shuffle (Spark's
    window group limit), so a column with many outliers sends `sample` rows per
    task.
    """
    df = nan_to_null(df)
    stats = outlier_stats(df, row_id=row_id) if stats is None else stats
    schema = f"column_name string, {row_id} long, value double, methods string"
    if not stats:
        return df.sparkSession.createDataFrame([], schema)
    entries = []
    for n, s in stats.items():
        agreeing = ", ".join(f"CASE WHEN {test} THEN '{method}' END" for method, test in flags(n, s).items())
        entries.append(
            f"CASE WHEN {any_flag(n, s)} THEN named_struct('column_name', {text_literal(n)}, "
            f"'value', CAST({quoted(n)} AS DOUBLE), 'methods', concat_ws(', ', {agreeing})) END"
        )
    votes = df.select(col(row_id), F.expr(f"explode(array({', '.join(entries)}))").alias("v")).where("v IS NOT NULL")
    order = Window.partitionBy("column_name").orderBy(col(row_id))
    return (
        votes.select("v.column_name", col(row_id), "v.value", "v.methods")
        .withColumn("_tw_n", F.row_number().over(order))
        .where(F.col("_tw_n") <= sample)
        .drop("_tw_n")
    )


def outlier_summary(
    df: DataFrame, row_id: str | None = None, stats: Mapping[str, OutlierStats] | None = None
) -> DataFrame:
    """Per column with outliers: their number, share of the values, both bounds."""
    df = nan_to_null(df)
    stats = outlier_stats(df, row_id=row_id) if stats is None else stats
    schema = (
        "column_name string, outlier_count long, outlier_percent double, iqr_lower double, "
        "iqr_upper double, z_lower double, z_upper double"
    )
    if not stats:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.selectExpr(*[f"count_if({any_flag(n, s)}) AS c{i}" for i, (n, s) in enumerate(stats.items())])
    entries = [
        f"named_struct('column_name', {text_literal(n)}, 'outlier_count', c{i}, "
        f"'outlier_percent', c{i} / {double(float(s.count))} * 100.0D, "
        f"'iqr_lower', {double(s.iqr_bounds[0])}, 'iqr_upper', {double(s.iqr_bounds[1])}, "
        f"'z_lower', {double(s.z_bounds[0])}, 'z_upper', {double(s.z_bounds[1])})"
        for i, (n, s) in enumerate(stats.items())
    ]
    return counts.selectExpr(f"inline(array({', '.join(entries)}))").where("outlier_count > 0")


def outlier_features(
    df: DataFrame, row_id: str | None = None, stats: Mapping[str, OutlierStats] | None = None
) -> DataFrame:
    """Per column with outliers: what the cause rules look at; one wide `agg`."""
    df = nan_to_null(df)
    stats = outlier_stats(df, row_id=row_id) if stats is None else stats
    schema = (
        "column_name string, outlier_count long, any_negative boolean, any_above_150 boolean, "
        "any_tenfold boolean, unit_factor boolean"
    )
    if not stats:
        return df.sparkSession.createDataFrame([], schema)
    aggregates, entries = [], []
    for i, (n, s) in enumerate(stats.items()):
        flagged, tenfold, factor = any_flag(n, s), "false", "false"
        if s.median > 0:
            ratio = f"CAST({quoted(n)} AS DOUBLE) / {double(s.median)}"
            tenfold, factor = f"{ratio} >= 10", f"bround({ratio}) IN (100, 1000)"
        aggregates += [
            f"count_if({flagged}) AS c{i}",
            f"count_if({flagged} AND {tenfold}) AS t{i}",
            f"count_if({flagged} AND {factor}) AS u{i}",
        ]
        entries.append(
            f"named_struct('column_name', {text_literal(n)}, 'outlier_count', c{i}, "
            f"'any_negative', {str(s.low < 0).lower()}, 'any_above_150', {str(s.high > 150).lower()}, "
            f"'any_tenfold', t{i} > 0, 'unit_factor', u{i} > 0)"
        )
    features = df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")
    return features.where("outlier_count > 0")


@dataclass(frozen=True)
class OutlierRule:
    cause: str
    when: Column
    explanation: str
    confidence: str
    action: str
    advice_confidence: str
    risk: str
    only_default: bool = False


_DEFAULT = "Keep Outliers"


def outlier_rules() -> list[OutlierRule]:
    """Cause rules in their fixed order, over the columns of `outlier_features`."""

    def named(words: Sequence[str]) -> Column:
        return F.lower("column_name").rlike("|".join(words))

    impossible = F.col("any_negative") & named(fv.NEVER_NEGATIVE_WORDS)
    return [
        OutlierRule("Cause A: Data Entry Error", impossible | F.col("any_tenfold"),
                    "negative where that is impossible, or ten times the median and more", "High",
                    "Correct or Remove", "High", "Medium"),
        OutlierRule("Cause B: Measurement Error", F.col("any_above_150") & named(["age"]),
                    "an age above 150", "High", "Remove or Correct", "High", "Medium"),
        OutlierRule("Cause H: Unit Conversion Error", F.col("unit_factor"),
                    "100 or 1000 times the median", "Medium",
                    "Standardize Units / Scale Column", "Medium", "Medium"),
        OutlierRule("Cause C: Genuine High/Low Value", named(fv.GENUINE_VALUE_WORDS),
                    "a business metric with genuine extremes", "High",
                    "Keep (Do NOT Remove)", "High", "Low", only_default=True),
        OutlierRule("Cause E: Fraud or Anomaly", named(fv.FRAUD_WORDS),
                    "extreme values in a transaction field", "Medium",
                    "Flag for Investigation", "Medium", "High"),
        OutlierRule("Cause G: Different Population Segment", F.lit(True),
                    "the values may belong to another segment", "Medium",
                    "Segment Analysis", "Medium", "Low", only_default=True),
    ]


def outlier_causes(features: DataFrame) -> DataFrame:
    """One row per (column, cause), causes in rule order."""
    entries = [
        F.when(
            rule.when,
            F.struct(
                F.lit(i).alias("cause_order"),
                F.lit(rule.cause).alias("cause"),
                F.lit(rule.explanation).alias("explanation"),
                F.lit(rule.confidence).alias("confidence"),
            ),
        )
        for i, rule in enumerate(outlier_rules(), start=1)
    ]
    return features.select("column_name", F.inline(F.array_compact(F.array(*entries))))


def outlier_advice(features: DataFrame) -> DataFrame:
    """The final recommendation per column: later rules replace earlier ones."""
    action, confidence, risk = F.lit(_DEFAULT), F.lit("High"), F.lit("Low")
    for rule in outlier_rules():
        applies = rule.when & (action == _DEFAULT) if rule.only_default else rule.when
        action, confidence, risk = (
            F.when(applies, F.lit(rule.action)).otherwise(action),
            F.when(applies, F.lit(rule.advice_confidence)).otherwise(confidence),
            F.when(applies, F.lit(rule.risk)).otherwise(risk),
        )
    return features.select(
        "column_name",
        "outlier_count",
        action.alias("recommended_action"),
        confidence.alias("confidence"),
        risk.alias("risk"),
    )


def segment_bounds(df: DataFrame, segment: str, columns: Sequence[str] | None = None, row_id: str | None = None) -> DataFrame:
    """(segment, column_name, n, lower, upper): quartile bounds of each column within each value of
    `segment`, where a segment has enough values. Rows without a segment are left out."""
    names = [n for n in (outlier_columns(df, row_id) if columns is None else columns) if n != segment]
    if not names:
        kind = df.schema[segment].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"segment {kind}, column_name string, n long, lower double, upper double")
    found = group_quantiles(df, segment, names, (0.25, 0.75)).where(F.col("n") >= fv.OUTLIER_MIN_VALUES)
    low, high = F.col("quantiles")[0], F.col("quantiles")[1]
    reach = F.lit(fv.IQR_FACTOR) * (high - low)
    return found.select("segment", "column_name", "n", (low - reach).alias("lower"), (high + reach).alias("upper"))


def segment_outliers(df: DataFrame, segment: str, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(row_id, segment, column_name, value, lower, upper) of every value outside the bounds of its
    own segment. Bounds are written once and joined by segment: a small table is broadcast by
    Spark, and a large segment's rows can be split."""
    bounds = materialise(segment_bounds(df, segment, columns, row_id))
    names = [n for n in (outlier_columns(df, row_id) if columns is None else columns) if n != segment]
    per_segment = bounds.groupBy("segment").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("lower", "upper")))).alias("of")
    )
    values = F.array(*[F.struct(F.lit(n).alias("column_name"), col(n).cast("double").alias("value")) for n in names])
    rows = df.select(col(row_id).alias("row_id"), col(segment).alias("segment"), values.alias("cells"))
    rows = rows.join(materialise(per_segment), "segment")
    rows = rows.select("row_id", "segment", "of", F.inline("cells")).withColumn("b", F.col("of")[F.col("column_name")])
    rows = rows.where("value < b.lower OR value > b.upper")
    return rows.select("row_id", "segment", "column_name", "value", "b.lower", "b.upper")


def segment_outlier_summary(df: DataFrame, segment: str, columns: Sequence[str] | None = None, row_id: str | None = None) -> DataFrame:
    """(segment, column_name, n, lower, upper, outlier_count) for every segment and column."""
    bounds = materialise(segment_bounds(df, segment, columns, row_id))
    numbered = df if row_id else df.withColumn("_tw_place", F.monotonically_increasing_id())
    flagged = segment_outliers(numbered, segment, row_id or "_tw_place", columns or outlier_columns(df, row_id))
    counts = flagged.groupBy("segment", "column_name").agg(F.count(F.lit(1)).alias("outlier_count"))
    return bounds.join(counts, ["segment", "column_name"], "left").withColumn(
        "outlier_count", F.coalesce("outlier_count", F.lit(0).cast("long"))
    )
