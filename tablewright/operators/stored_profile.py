"""Profiles that are kept and merged: facts of days 1..n without reading their rows again.

`profile_parts` reads a table once and gives a few kilobytes per part and column:
counts, extremes, sums, a HyperLogLog sketch of the distinct values and a KLL
sketch of the ranks. Write that frame next to the table, append the parts of new
days to it, and `merge_parts` gives the profile of any choice of parts. Missing
counts, extremes and means are exact; distinct counts and quantiles are estimates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.columns import (
    col,
    data_types,
    is_boolean,
    is_numeric,
    nan_to_null,
    quoted,
    text_literal,
    text_sql,
)

DISTINCT_BITS = 14  # 2 ** 14 registers: a relative error near 0.8 percent
RANK_SIZE = 800  # a rank error near 0.4 percent
_FACTS = ["ordinal", "column_name", "data_type", "is_numeric"]


def _distinct_value(name: str, dtype: T.DataType) -> str:
    """SQL for what the sketch of distinct values takes in; it would leave out empty texts."""
    if isinstance(dtype, T.IntegralType):
        return f"CAST({quoted(name)} AS BIGINT)"
    return f"concat('=', {text_sql(name, dtype)})"


def profile_parts(
    df: DataFrame,
    by: Sequence[str] = (),
    row_id: str | None = None,
    distinct_bits: int = DISTINCT_BITS,
    rank_size: int = RANK_SIZE,
) -> DataFrame:
    """One row per part (the values of `by`, say a day) and column, in one scan.

    Partial sketches are made before the shuffle, so a part with most of the rows
    is no hot group. NULL in `by` is a part of its own; an empty table without `by`
    gives one part with zero rows, with `by` none. `by` columns are not profiled.
    """
    df = nan_to_null(df)
    types = {n: t for n, t in data_types(df, row_id).items() if n not in set(by)}
    aggregates, entries = ["count(1) AS _tw_rows"], []
    for i, (n, t) in enumerate(types.items()):
        numeric = is_numeric(t) or is_boolean(t)
        aggregates += [
            f"count({quoted(n)}) AS _tw_n{i}",
            f"hll_sketch_agg({_distinct_value(n, t)}, {distinct_bits}) AS _tw_h{i}",
        ]
        numbers = ["CAST(NULL AS DOUBLE)"] * 3 + ["CAST(NULL AS BINARY)"]
        if numeric:
            x = f"CAST(CAST({quoted(n)} AS INT) AS DOUBLE)" if is_boolean(t) else f"CAST({quoted(n)} AS DOUBLE)"
            aggregates += [f"{f}({x}) AS _tw_{f}{i}" for f in ("min", "max", "sum")]
            aggregates.append(f"kll_sketch_agg_double({x}, {rank_size}) AS _tw_k{i}")
            numbers = [f"_tw_{f}{i}" for f in ("min", "max", "sum", "k")]
        entries.append(
            f"named_struct('ordinal', {i}, 'column_name', {text_literal(n)}, 'data_type', '{t.simpleString()}', "
            f"'is_numeric', {str(numeric).lower()}, 'rows', _tw_rows, 'non_null', _tw_n{i}, 'min_value', {numbers[0]}, "
            f"'max_value', {numbers[1]}, 'sum_value', {numbers[2]}, 'distinct_sketch', _tw_h{i}, 'rank_sketch', {numbers[3]})"
        )
    if not entries:
        raise ValueError("no columns to profile")
    keys = [col(n) for n in by]
    parts = df.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])
    return parts.selectExpr(*[quoted(n) for n in by], f"inline(array({', '.join(entries)}))")


def merge_parts(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same rows for coarser parts: those of `by`, or the whole table.

    Merged parts can be stored and merged again. A column that only some parts have
    counts the rows of those parts.
    """
    return parts.groupBy(*[col(n) for n in by], *_FACTS).agg(
        F.sum("rows").alias("rows"),
        F.sum("non_null").alias("non_null"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.sum("sum_value").alias("sum_value"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("rank_sketch").alias("rank_sketch"),
    )


def _parted(parts: DataFrame) -> list[Column]:
    known = {*_FACTS, "rows", "non_null", "min_value", "max_value", "sum_value", "distinct_sketch", "rank_sketch"}
    return [col(n) for n in parts.columns if n not in known]


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def stored_column_profile(parts: DataFrame) -> DataFrame:
    """The columns of `column_profile`, for every part; `unique_count` is an estimate.

    An estimate never exceeds the number of values.
    """
    unique = F.least(F.hll_sketch_estimate("distinct_sketch"), F.col("non_null"))
    return parts.select(
        *_parted(parts),
        "ordinal",
        "column_name",
        "data_type",
        (F.col("rows") - F.col("non_null")).alias("missing_count"),
        unique.alias("unique_count"),
        F.coalesce(F.try_divide(unique.cast("double"), F.col("non_null")), F.lit(0.0)).alias("unique_ratio"),
        "is_numeric",
        _finite(F.col("min_value")).alias("min_value"),
        _finite(F.col("max_value")).alias("max_value"),
        _finite(F.try_divide(F.col("sum_value"), F.col("non_null"))).alias("mean_value"),
    )


def stored_quantiles(parts: DataFrame, ps: Sequence[float]) -> DataFrame:
    """(part, column_name, p, value) for the numeric columns: a value of the column near rank p.

    Columns without a value have none.
    """
    filled = parts.where(F.col("is_numeric") & (F.col("non_null") > 0))
    points = ", ".join(f"{float(p)!r}D" for p in ps)
    ranks = filled.select(
        *_parted(parts),
        "column_name",
        F.expr(
            f"inline(arrays_zip(array({points}), kll_sketch_get_quantile_double(rank_sketch, array({points}))))"
        ),
    )
    return ranks.toDF(*[*ranks.columns[:-2], "p", "value"])


def stored_outlier_bounds(parts: DataFrame) -> DataFrame:
    """(part, column_name, method, lower, upper) of the IQR and percentile methods.

    Bounds come from sketched quantiles; columns with too few values have none. The
    other two methods need deviations from a mean or median that parts don't share.
    """
    enough = parts.where(F.col("is_numeric") & (F.col("non_null") >= fv.OUTLIER_MIN_VALUES))
    quartile = F.expr("kll_sketch_get_quantile_double(rank_sketch, array(0.01D, 0.25D, 0.75D, 0.99D))")
    reach = F.lit(fv.IQR_FACTOR) * (F.col("_tw_q")[2] - F.col("_tw_q")[1])

    def bound(method: str, low: Column, high: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), low.alias("lower"), high.alias("upper"))

    return enough.withColumn("_tw_q", quartile).select(
        *_parted(parts),
        "column_name",
        F.inline(
            F.array(
                bound("IQR", F.col("_tw_q")[1] - reach, F.col("_tw_q")[2] + reach),
                bound("Percentiles", F.col("_tw_q")[0], F.col("_tw_q")[3]),
            )
        ),
    )
