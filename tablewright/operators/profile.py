"""Profile of a table: sizes, missing cells, duplicates, columns, score, issues.

Every function takes the table and returns a lazy frame. Frames that others are
built on (`table_stats`, `column_profile`) can be passed in so that a caller who
persists them pays for one pass only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.columns import (
    col,
    count_if,
    data_types,
    is_boolean,
    is_float,
    is_nested,
    is_numeric,
    missing_cells,
    nan_to_null,
    quoted,
    row_digest,
    row_key,
    text_literal,
    text_sql,
)
from ..functions.frequencies import distinct_counts


def table_stats(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row: row_count, column_count, missing_values, duplicate_rows, missing_percent.

    Equal rows share their key, and with it their number of missing cells, so one
    grouping by (key, missing cells) answers all four counts in one scan.
    """
    df = nan_to_null(df)
    types = data_types(df, row_id)
    keyed = df.select(*row_key(types), missing_cells(types).alias("missing"))
    groups = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
    cells = F.col("row_count") * len(types)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.lit(len(types)).alias("column_count"),
        F.coalesce(F.sum(F.col("n") * F.col("missing")), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn(
        "missing_percent",
        F.coalesce(F.try_divide(F.col("missing_values"), cells) * 100.0, F.lit(0.0)),
    )


def duplicate_count(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Rows equal to an earlier row; NULLs are equal to each other."""
    return table_stats(df, row_id).select("duplicate_rows")


def preview(df: DataFrame, order_by: list[str], limit: int = 10) -> DataFrame:
    """The first rows as text; common magnitudes are written without an exponent."""
    first = nan_to_null(df).orderBy(*[col(c) for c in order_by]).limit(limit)
    return first.selectExpr(*[f"{_shown(n, t)} AS {quoted(n)}" for n, t in data_types(df).items()])


def _shown(name: str, dtype) -> str:
    if is_nested(dtype):
        return text_sql(name, dtype)
    value = quoted(name)
    if not is_float(dtype) or dtype.typeName() == "decimal":
        return f"CAST({value} AS STRING)"
    # a decimal writes all digits; trailing zeros go, one digit stays
    digits = f"regexp_replace(CAST(CAST({value} AS DECIMAL(38, 20)) AS STRING), '([.][0-9]+?)0+$', '$1')"
    plain = f"abs({value}) >= 0.0001D AND abs({value}) < 1E16D AND (abs({value}) >= 1E7D OR abs({value}) < 0.001D)"
    return f"CASE WHEN {plain} THEN {digits} ELSE CAST({value} AS STRING) END"


def _column_facts(df: DataFrame, types: dict) -> DataFrame:
    """One row per column: missing, non-null, min, max, mean; a single wide `agg`."""
    aggregates = ["count(1) AS rows"]
    entries = []
    for i, (n, t) in enumerate(types.items()):
        aggregates.append(f"count({quoted(n)}) AS n{i}")
        numeric = is_numeric(t) or is_boolean(t)
        facts = ["CAST(NULL AS DOUBLE)"] * 3
        if numeric:
            x = f"CAST(CAST({quoted(n)} AS INT) AS DOUBLE)" if is_boolean(t) else f"CAST({quoted(n)} AS DOUBLE)"
            aggregates += [f"{f}({x}) AS {f}{i}" for f in ("min", "max", "avg")]
            # NaN compares above every number, so only finite values pass
            facts = [f"CASE WHEN abs({f}{i}) < double('Infinity') THEN {f}{i} END" for f in ("min", "max", "avg")]
        entries.append(
            f"named_struct('ordinal', {i}, 'column_name', {text_literal(n)}, 'data_type', '{t.simpleString()}', "
            f"'missing_count', rows - n{i}, 'non_null', n{i}, 'is_numeric', {str(numeric).lower()}, "
            f"'min_value', {facts[0]}, 'max_value', {facts[1]}, 'mean_value', {facts[2]})"
        )
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")


def column_profile(df: DataFrame, row_id: str | None = None, approx: bool = False) -> DataFrame:
    """One row per column, in table order, with missing, distinct and numeric facts.

    `approx=True` replaces exact distinct counts by sketches (no shuffle of values).
    """
    return _profile(df, row_id, approx, lambda t: True)


def _cardinalities(df: DataFrame, row_id: str | None, approx: bool) -> DataFrame:
    """The profile with distinct counts of those columns only that can be fragmented."""
    return _profile(df, row_id, approx, lambda t: not (is_numeric(t) or is_boolean(t)))


def _profile(df: DataFrame, row_id: str | None, approx: bool, counted: Callable[[T.DataType], bool]) -> DataFrame:
    df = nan_to_null(df)
    types = data_types(df, row_id)
    joined = _column_facts(df, types)
    names = [n for n, t in types.items() if counted(t)]
    if names:
        # Both sides have one row per column of the table.
        joined = joined.join(F.broadcast(distinct_counts(df, names, approx)), "column_name", "left")
    else:
        joined = joined.withColumn("unique_count", F.lit(None).cast("long"))
    unique = F.coalesce(F.col("unique_count"), F.lit(0))
    return joined.select(
        "ordinal",
        "column_name",
        "data_type",
        "missing_count",
        unique.alias("unique_count"),
        F.coalesce(F.try_divide(unique.cast("double"), F.col("non_null")), F.lit(0.0)).alias("unique_ratio"),
        "is_numeric",
        "min_value",
        "max_value",
        "mean_value",
    )


def numeric_stats(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """min, max and mean of every numeric column; NULL when not finite."""
    df = nan_to_null(df)
    types = {n: t for n, t in data_types(df, row_id).items() if is_numeric(t) or is_boolean(t)}
    return _column_facts(df, types).select("column_name", "min_value", "max_value", "mean_value")


def _high_cardinality() -> Column:
    return ~F.col("is_numeric") & (F.col("unique_ratio") > fv.HIGH_CARDINALITY_RATIO)


def score_bucket(score: Column) -> Column:
    """Colour name of a score."""
    bucket = F.lit(fv.LOWEST_BUCKET)
    for least, name in reversed(fv.SCORE_BUCKETS):
        bucket = F.when(score >= least, F.lit(name)).otherwise(bucket)
    return bucket


def quality_score(
    df: DataFrame,
    row_id: str | None = None,
    stats: DataFrame | None = None,
    columns: DataFrame | None = None,
    approx: bool = False,
) -> DataFrame:
    """One row: the counts behind the score, the 0..100 score and its colour.

    Only text and date columns have their distinct values counted; `approx=True` does it
    with sketches.
    """
    stats = table_stats(df, row_id) if stats is None else stats
    columns = _cardinalities(df, row_id, approx) if columns is None else columns
    fragmented = columns.agg(count_if(_high_cardinality()).alias("n"))
    raw = (
        F.lit(100.0)
        - F.col("missing_percent") * fv.MISSING_PENALTY
        - F.when(F.col("duplicate_rows") > 0, fv.DUPLICATE_PENALTY).otherwise(0.0)
        - F.col("high_cardinality_columns") * fv.HIGH_CARDINALITY_PENALTY
    )
    scored = stats.withColumn("high_cardinality_columns", fragmented.scalar()).withColumn(
        "quality_score", F.bround(F.greatest(F.lit(0.0), raw)).cast("int")
    )
    return scored.withColumn("score_bucket", score_bucket(F.col("quality_score")))


def issues(
    df: DataFrame,
    row_id: str | None = None,
    stats: DataFrame | None = None,
    columns: DataFrame | None = None,
    approx: bool = False,
) -> DataFrame:
    """Findings in report order: missing columns, duplicates, fragmented columns."""
    stats = table_stats(df, row_id) if stats is None else stats
    columns = _cardinalities(df, row_id, approx) if columns is None else columns
    width = len(data_types(df, row_id))

    def finding(position: Column, issue: str, name: Column, amount: Column) -> Column:
        return F.struct(
            position.cast("int").alias("position"),
            F.lit(issue).alias("issue"),
            name.cast("string").alias("column_name"),
            amount.cast("bigint").alias("amount"),
        )

    ordinal, name, nothing = F.col("ordinal"), F.col("column_name"), F.lit(None)
    by_column = columns.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("missing_count") > 0,
                        finding(ordinal, "missing values", name, F.col("missing_count")),
                    ),
                    F.when(
                        _high_cardinality(),
                        finding(ordinal + width + 1, "high cardinality", name, F.col("unique_count")),
                    ),
                )
            )
        )
    )
    twins = F.when(
        F.col("duplicate_rows") > 0,
        finding(F.lit(width), "duplicate rows", nothing, F.col("duplicate_rows")),
    )
    found = by_column.unionByName(stats.select(F.inline(F.array_compact(F.array(twins)))))
    healthy = finding(F.lit(0), "healthy", nothing, F.lit(0))
    return or_else(found, healthy).orderBy("position")


def or_else(findings: DataFrame, fallback: Column) -> DataFrame:
    """The findings, or one fallback row when there are none.

    Findings number a few per column of the table, so they fit one row.
    """
    listed = findings.agg(F.collect_list(F.struct(*findings.columns)).alias("rows"))
    return listed.select(
        F.inline(F.when(F.size("rows") == 0, F.array(fallback)).otherwise(F.col("rows")))
    )


def _null_counts(df: DataFrame, types: dict) -> DataFrame:
    return nan_to_null(df).selectExpr(
        "count(1) AS rows", *[f"count_if({quoted(n)} IS NULL) AS m{i}" for i, n in enumerate(types)]
    )


def completeness_score(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Share of filled cells, 0..100, two decimals; 0 for a table without cells."""
    types = data_types(df, row_id)
    missing = " + ".join(["0", *[f"m{i}" for i in range(len(types))]])
    share = f"try_divide({missing}, rows * {len(types)})"
    return _null_counts(df, types).selectExpr(
        f"coalesce(bround((1 - {share}) * 100, 2), 0.0D) AS completeness_score"
    )


def missing_by_column(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Columns with missing values: count, share of rows in percent."""
    types = data_types(df, row_id)
    entries = [
        f"named_struct('ordinal', {i}, 'column_name', {text_literal(n)}, 'missing_count', m{i}, "
        f"'missing_percent', coalesce(try_divide(m{i}, rows) * 100.0D, 0.0D))"
        for i, n in enumerate(types)
    ]
    return (
        _null_counts(df, types).selectExpr(f"inline(array({', '.join(entries)}))").where("missing_count > 0")
    )


def duplicate_sample(df: DataFrame, row_id: str, limit: int = 10) -> DataFrame:
    """The first rows (all copies) that have a twin.

    A row among the first `limit` belongs to one of the `limit` groups that start
    earliest, so only those groups are looked up again; no group is ever held
    together, however many copies it has.
    """
    df = nan_to_null(df)
    types = data_types(df, row_id)
    keyed = df.withColumn("_tw_digest", row_digest(types))
    earliest = (
        keyed.groupBy("_tw_digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(col(row_id)).alias("start"))
        .where("n > 1")
        .orderBy("start")
        .limit(limit)
        .select("_tw_digest")
    )
    return (
        keyed.join(F.broadcast(earliest), "_tw_digest", "left_semi")
        .orderBy(col(row_id))
        .limit(limit)
        .drop("_tw_digest")
    )
