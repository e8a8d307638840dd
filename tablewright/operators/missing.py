"""Why are values missing? Features per column, causes, advice.

The table needs a contiguous row id (`ordering.with_row_id`). All results have
one row per column (or per column and segment); the table is only scanned by
aggregates that combine before the shuffle, and runs are found block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import (
    ROW_ID,
    as_text,
    col,
    count_if,
    data_types,
    is_category,
    is_numeric,
    is_temporal,
    name_has,
    nan_to_null,
    quoted,
    text_literal,
)
from ..functions.frequencies import small_value_sets
from .ordering import block_rows_for
from .profile import missing_by_column

_MASK_BITS = 60  # columns whose gaps one number holds


def missing_summary(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Columns with missing values, their number and share of the rows."""
    return missing_by_column(df, row_id).select("column_name", "missing_count", "missing_percent")


def columns_with_gaps(df: DataFrame, row_id: str | None = None) -> list[str]:
    types = data_types(df, row_id)
    if not types:
        return []
    df = nan_to_null(df)
    row = df.selectExpr(*[f"max({quoted(n)} IS NULL) AS m{i}" for i, n in enumerate(types)]).first()
    return [n for i, n in enumerate(types) if row[f"m{i}"]]


def is_temporal_column(name: str, dtype) -> bool:
    return is_temporal(dtype) or name_has(name, fv.DATE_NAME_WORDS)


def longest_null_run(
    df: DataFrame,
    row_id: str = ROW_ID,
    columns: list[str] | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Longest block of consecutive missing values per column with gaps.

    Only row ids and a bit per column are shuffled. In a block, a row's distance from the last
    filled row before it is the length of its run so far. Runs over block ends follow
    from a row per block and column (at most MAX_BLOCKS blocks): its rows before the first
    and up to the last filled one. Rows without an id have no place and are left out.
    """
    df = nan_to_null(df)
    chosen = columns_with_gaps(df, row_id) if columns is None else columns
    if not chosen:
        return df.sparkSession.createDataFrame([], "column_name string, longest_run long")
    size = block_rows or block_rows_for(df, row_id)
    masks = []
    for start in range(0, len(chosen), _MASK_BITS):
        part = enumerate(chosen[start : start + _MASK_BITS])
        masks.append(" | ".join(f"shiftleft(CAST({quoted(n)} IS NULL AS BIGINT), {i})" for i, n in part))
    rid = quoted(row_id)
    rows = df.where(col(row_id).isNotNull()).selectExpr(
        f"{rid} DIV {size} AS block", f"{rid} AS id", *[f"{m} AS m{k}" for k, m in enumerate(masks)]
    )
    order = Window.partitionBy("block").orderBy("id")
    rows = rows.withColumn("at", F.row_number().over(order))
    filled = [f"CASE WHEN m{i // _MASK_BITS} & {1 << i % _MASK_BITS}L = 0 THEN at END" for i in range(len(chosen))]
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"f{i}": F.max(F.expr(x)).over(upto) for i, x in enumerate(filled)})
    # The frame is dealt by block already.
    blocks = rows.groupBy("block").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.min(f"f{i}").alias(f"a{i}") for i in range(len(chosen))],
        *[F.max(f"f{i}").alias(f"z{i}") for i in range(len(chosen))],
        *[F.max(F.col("at") - F.col(f"f{i}")).alias(f"r{i}") for i in range(len(chosen))],
    )
    entries = ", ".join(
        f"named_struct('column_name', {text_literal(n)}, 'first', a{i}, 'last', z{i}, 'inside', r{i})" for i, n in enumerate(chosen)
    )
    ends = blocks.selectExpr("block", "rows", f"inline(array({entries}))")
    earlier = Window.partitionBy("column_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    known = F.last(F.col("before") + F.col("last"), ignorenulls=True).over(earlier)
    head = F.col("before") + F.coalesce(F.col("first") - 1, F.col("rows")) - F.coalesce(known, F.lit(0))
    runs = ends.select("column_name", F.greatest("inside", head).alias("run"))
    return runs.groupBy("column_name").agg(F.max("run").alias("longest_run")).where("longest_run > 0")


def missing_position(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Per column with gaps: is it temporal, is the first/last row missing, is the tail all of it?"""
    df = nan_to_null(df)
    types = data_types(df, row_id)
    rid = quoted(row_id)
    aggregates, entries = ["count(1) AS rows"], []
    for i, (n, t) in enumerate(types.items()):
        gap = f"{quoted(n)} IS NULL"
        aggregates += [
            f"count_if({gap}) AS m{i}",
            f"min_by({gap}, {rid}) AS s{i}",
            f"max_by({gap}, {rid}) AS e{i}",
            f"min(CASE WHEN {gap} THEN {rid} END) AS g{i}",
            f"max(CASE WHEN NOT {gap} THEN {rid} END) AS v{i}",
        ]
        temporal = str(is_temporal_column(n, t)).lower()
        entries.append(
            f"named_struct('ordinal', {i}, 'column_name', {text_literal(n)}, 'is_numeric', {str(is_numeric(t)).lower()}, "
            f"'missing_count', m{i}, 'missing_percent', m{i} / rows * 100.0D, 'is_temporal', {temporal}, 'missing_at_start', {temporal} AND s{i}, "
            f"'missing_at_end', {temporal} AND e{i}, 'missing_tail_only', NOT {temporal} AND coalesce(v{i} < g{i}, true))"
        )
    positions = df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")
    return positions.where("missing_count > 0")


def missing_at_edges(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """First/last row missing, for temporal columns."""
    return missing_position(df, row_id).select(
        "column_name", "is_temporal", "missing_at_start", "missing_at_end"
    )


def missing_tail_only(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Columns whose missing values are exactly the last rows."""
    return missing_position(df, row_id).select("column_name", "missing_tail_only")


def segment_columns(df: DataFrame, row_id: str | None = None) -> list[str]:
    """Categorical columns with fewer than 15 values."""
    types = data_types(df, row_id)
    names = [n for n, t in types.items() if is_category(t)]
    return list(small_value_sets(df, names, fv.SEGMENT_MAX_DISTINCT - 1))


def _segment_counts(df: DataFrame, gaps: list[str], segments: list[str]) -> DataFrame:
    """(segment_column, segment, segment_rows, column_name, missing_count): one grouping by (segment
    column, segment) counts all columns at once; it yields at most 14 rows per segment column."""
    types = data_types(df)
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("segment_column"), as_text(n, types[n]).alias("segment"))
                    for n in segments
                ]
            )
        ).alias("s"),
        *[col(n).isNull().alias(f"g{i}") for i, n in enumerate(gaps)],
    ).where(F.col("s.segment").isNotNull())
    counts = cells.groupBy("s.segment_column", "s.segment").agg(
        F.count(F.lit(1)).alias("segment_rows"), *[count_if(F.col(f"g{i}")).alias(f"g{i}") for i in range(len(gaps))]
    )
    long = counts.select(
        "segment_column",
        "segment",
        "segment_rows",
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("column_name"), F.col(f"g{i}").alias("missing_count")) for i, n in enumerate(gaps)]
            )
        ),
    )
    return long.where(F.col("segment_column") != F.col("column_name"))


def missing_by_segment(
    df: DataFrame, row_id: str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Segments in which more than half of a column is missing (and more than 3 rows)."""
    df = nan_to_null(df)
    gaps = columns_with_gaps(df, row_id) if columns is None else columns
    segments = segment_columns(df, row_id)
    schema = (
        "column_name string, segment_column string, segment string, segment_rows long, "
        "missing_count long, missing_percent double"
    )
    if not gaps or not segments:
        return df.sparkSession.createDataFrame([], schema)
    percent = F.col("missing_count") / F.col("segment_rows") * 100.0
    return (
        _segment_counts(df, gaps, segments)
        .withColumn("missing_percent", percent)
        .where(F.col("missing_percent") > fv.SEGMENT_MIN_PERCENT)
        .where(F.col("segment_rows") > fv.SEGMENT_MIN_ROWS)
        .select("column_name", "segment_column", "segment", "segment_rows", "missing_count", "missing_percent")
        .orderBy("column_name", "segment_column", F.desc("missing_percent"), "segment")
    )


def missing_association(df: DataFrame, row_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """(column_name, segment_column, segments, rows, missing_count, chi_square, cramers_v): how far
    missing values of a column go with the values of a segment column, from 0 to 1.

    Finds what the fixed rule of `missing_by_segment` cannot: shares that differ but stay under a
    half, or exceed it everywhere. Rows without a segment are left out. Chi-square and V are null
    where there is nothing to compare: one segment, or all or no values missing in these rows.
    """
    df = nan_to_null(df)
    gaps = columns_with_gaps(df, row_id) if columns is None else columns
    segments = segment_columns(df, row_id)
    if not gaps or not segments:
        schema = "column_name string, segment_column string, segments long, rows long, missing_count long, chi_square double, cramers_v double"
        return df.sparkSession.createDataFrame([], schema)
    # With m of r rows missing in a segment, M of n in all: sum of (m - r M/n)^2 / (r M/n (1 - M/n)).
    # The sum of m^2 / r carries all of it, so one more grouping of the counts is enough.
    m, r = F.col("missing_count"), F.col("segment_rows")
    sums = _segment_counts(df, gaps, segments).groupBy("column_name", "segment_column").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(r).alias("rows"), F.sum(m).alias("missing_count"),
        F.sum(m.cast("double") * m / r).alias("squares"),
    )
    n, total = F.col("rows").cast("double"), F.col("missing_count").cast("double")
    compares = (F.col("segments") > 1) & (total > 0) & (total < n)
    chi = F.greatest(F.lit(0.0), (F.col("squares") - total * total / n) * n * n / (total * (n - total)))
    sums = sums.withColumn("chi_square", F.when(compares, chi))
    v = F.when(F.col("chi_square").isNotNull(), F.least(F.lit(1.0), F.sqrt(F.col("chi_square") / n)))
    return sums.select("column_name", "segment_column", "segments", "rows", "missing_count", "chi_square", v.alias("cramers_v"))


def missing_features(
    df: DataFrame, row_id: str = ROW_ID, block_rows: int | None = None
) -> DataFrame:
    """One row per column with gaps: everything the cause rules look at."""
    df = nan_to_null(df)
    positions = missing_position(df, row_id)
    found = positions.collect()  # a row per column
    gaps = [r["column_name"] for r in found]
    runs = longest_null_run(df, row_id, gaps, block_rows)
    patterns = missing_by_segment(df, row_id, gaps).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("segments")
    )
    # All sides have at most one row per column of the table.
    return (
        df.sparkSession.createDataFrame(found, positions.schema)
        .join(F.broadcast(runs), "column_name", "left")
        .join(F.broadcast(patterns), "column_name", "left")
        .withColumn("longest_run", F.coalesce("longest_run", F.lit(0)))
        .withColumn("segments", F.coalesce("segments", F.lit(0)))
    )


@dataclass(frozen=True)
class Rule:
    """A cause: when it holds, how sure it is, and what it recommends.

    `keeps` marks advice that only counts while nothing stronger was advised.
    """

    cause: str
    when: Column
    confidence: str
    explanation: Column
    action: Column
    advice_confidence: str
    risk: str
    keeps: bool = False


def _named(words: list[str]) -> Column:
    return F.lower("column_name").rlike("|".join(words))


def cause_rules() -> list[Rule]:
    """Cause rules in their fixed order, over the columns of `missing_features`."""
    percent, run = F.col("missing_percent"), F.col("longest_run")
    share = F.concat(F.format_number(percent, 1), F.lit("% of the rows are missing"))
    excessive = "Cause I: Excessive Missingness"
    text = F.lit
    return [
        Rule(excessive, percent >= fv.CRITICAL_MISSING_PERCENT, "High", share,
             text("Request User Review / Drop Column"), "High", "High"),
        Rule(excessive,
             (percent >= fv.HIGH_MISSING_PERCENT) & (percent < fv.CRITICAL_MISSING_PERCENT), "Medium", share,
             text("Request User Review"), "Medium", "Medium"),
        Rule("Cause C: Intentionally Left Blank", _named(fv.OPTIONAL_WORDS), "High",
             text("the name suggests an optional field"), text("Keep NULL"), "High", "Low", keeps=True),
        Rule("Cause D: Not Applicable", _named(fv.NOT_APPLICABLE_WORDS), "High",
             text("the field does not apply to every record"),
             text("Convert to 'N/A' or Keep NULL"), "High", "Low", keeps=True),
        Rule("Cause E: Future Placeholder Data", F.col("is_temporal") & F.col("missing_at_end"), "Medium",
             text("the last row in order is empty"), text("Keep Empty / Do Not Impute"), "High", "Low", keeps=True),
        Rule("Cause B: System Failure", run >= fv.OUTAGE_RUN, "Medium",
             F.concat(run.cast("string"), text(" rows in a row are missing")),
             text("Interpolate or Forward Fill"), "Medium", "Medium"),
        Rule("Cause F: Data Still Being Collected", F.col("missing_tail_only"), "Medium",
             text("only the last rows are missing"), text("Mark as Pending / Keep NULL"), "Medium", "Medium"),
        Rule("Cause G: Privacy or Compliance Removal", _named(fv.SENSITIVE_WORDS), "Medium",
             text("the name suggests personal data"), text("Preserve NULL"), "Medium", "Low"),
        Rule("Cause H: Missingness Has Predictive Value", F.col("segments") > 0, "High",
             F.concat(F.col("segments").cast("string"), text(" segments are mostly missing")),
             F.concat(text("Create Missing Indicator Feature (e.g. "), F.col("column_name"), text("_missing = 1)")),
             "High", "Low"),
    ]


_FALLBACK = "Cause A: Data Entry Error"


def missing_causes(features: DataFrame) -> DataFrame:
    """One row per (column, cause), causes in rule order."""
    rules = cause_rules()
    any_cause = F.lit(False)
    for rule in rules:
        any_cause = any_cause | rule.when
    entries = [
        F.when(
            rule.when,
            F.struct(
                F.lit(i).alias("cause_order"),
                F.lit(rule.cause).alias("cause"),
                rule.explanation.alias("explanation"),
                F.lit(rule.confidence).alias("confidence"),
            ),
        )
        for i, rule in enumerate(rules, start=1)
    ]
    entries.append(
        F.when(
            ~any_cause,
            F.struct(
                F.lit(len(rules) + 1).alias("cause_order"),
                F.lit(_FALLBACK).alias("cause"),
                F.lit("missing rows show no pattern").alias("explanation"),
                F.lit("Medium").alias("confidence"),
            ),
        )
    )
    return features.select("column_name", F.inline(F.array_compact(F.array(*entries))))


def missing_advice(features: DataFrame) -> DataFrame:
    """The final recommendation per column: later rules replace earlier ones."""
    keep = "Keep NULL"
    action, confidence, risk = F.lit(keep), F.lit("High"), F.lit("Low")
    any_cause = F.lit(False)
    for rule in cause_rules():
        applies = rule.when & (action == keep) if rule.keeps else rule.when
        action, confidence, risk = (
            F.when(applies, rule.action).otherwise(action),
            F.when(applies, F.lit(rule.advice_confidence)).otherwise(confidence),
            F.when(applies, F.lit(rule.risk)).otherwise(risk),
        )
        any_cause = any_cause | rule.when
    imputation = (
        F.when(F.col("is_numeric"), "Median Imputation")
        .when(F.col("is_temporal"), "Forward Fill")
        .otherwise("Mode Imputation")
    )
    return features.select(
        "column_name",
        "missing_count",
        "missing_percent",
        "longest_run",
        "is_temporal",
        "missing_at_start",
        "missing_at_end",
        F.when(any_cause, action).otherwise(imputation).alias("recommended_action"),
        F.when(any_cause, confidence).otherwise(F.lit("Medium")).alias("confidence"),
        F.when(any_cause, risk).otherwise(F.lit("Low")).alias("risk"),
    )
