"""The automatic cleaning run and the advice given before it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    is_fillable,
    ROW_ID,
    col,
    count_if,
    data_types,
    is_numeric,
    is_temporal,
    is_text,
    nan_to_null,
    per_column,
    quoted,
)
from ..functions.frequencies import modes
from ..functions.quantiles import approx_quantiles, exact_quantiles
from ..functions.storage import materialise
from ..functions.text import has_extra_spaces, number_of, snake_case_labels
from ..operators import cleaning as c
from ..operators.ordering import with_row_id
from ..operators.profile import or_else, quality_score, table_stats
from .audit import AuditLog


@dataclass
class CleanResult:
    table: DataFrame
    metrics: DataFrame
    log: DataFrame


def clean_table(
    df: DataFrame,
    row_id: str | None = None,
    order_by: Sequence[str] = (),
    approx: bool = False,
) -> CleanResult:
    """Empty rows, duplicates, names, then per column: trim, dates, numbers, fill.

    Pass `row_id` when the table already carries ids; otherwise ids follow
    `order_by` or the file order. The rows left after removing duplicates are
    written once, so the later passes do not repeat that shuffle.
    """
    df = nan_to_null(df)
    if row_id is None:
        row_id = ROW_ID
        df = with_row_id(df, order_by, row_id)
    log = AuditLog()

    empty_row = _all_missing(data_types(df, row_id))
    rows_before, empty = df.agg(F.count(F.lit(1)), count_if(empty_row)).first()
    kept = materialise(c.drop_duplicates_first(c.drop_empty_rows(df, row_id), row_id))
    # Missing cells are counted before any conversion: values that conversion
    # turns into NULL are only filled in columns that had gaps to begin with.
    old = list(data_types(kept, row_id))
    row = kept.selectExpr(
        "count(1) AS n", *[f"count_if({quoted(n)} IS NULL) AS m{i}" for i, n in enumerate(old)]
    ).first()
    rows_after = row["n"]
    copies = rows_before - empty - rows_after
    if empty:
        log.add(None, "drop_empty_rows", empty, message=f"Removed {empty} empty rows.")
    if copies:
        log.add(None, "drop_duplicates", copies, message=f"Removed {copies} duplicate rows.")

    table = c.snake_case_columns(kept, row_id)
    renamed = sum(a != b for a, b in zip(old, snake_case_labels(old)))
    if renamed:
        log.add(None, "rename_columns", renamed, message=f"Renamed {renamed} columns to snake_case.")

    gaps = [n for i, n in enumerate(data_types(table, row_id)) if row[f"m{i}"]]

    table = c.trim_text(table, c.text_columns(table, row_id))
    dates = c.date_columns(table, row_id)
    table = c.parse_dates(table, row_id, dates)
    for n in dates:
        log.add(n, "parse_dates", message=f"Converted '{n}' to timestamps.")
    numbers = c.numeric_text_columns(table, c.text_columns(table, row_id))
    table = c.replace_columns(table, {n: c.to_number(n, t) for n, t in numbers.items()})
    for n in numbers:
        log.add(n, "coerce_numeric", message=f"Converted text column '{n}' to numbers.")

    table, filled_cells = _fill_gaps(table, gaps, row_id, rows_after, approx, log)
    before = quality_score(df, row_id).select(F.col("quality_score").alias("quality_before"))
    after = quality_score(table, row_id).select(F.col("quality_score").alias("quality_after"))
    counts = df.sparkSession.createDataFrame(
        [(rows_before, rows_after, filled_cells, copies, empty, renamed, len(dates) + len(numbers))],
        "rows_before long, rows_after long, missing_filled long, duplicates_removed long, "
        "empty_rows_removed long, columns_renamed int, datatypes_fixed int",
    )
    metrics = counts.withColumns({"quality_before": before.scalar(), "quality_after": after.scalar()})
    return CleanResult(table, metrics, log.frame(df.sparkSession))


def _fill_gaps(table, gaps, row_id, rows, approx, log):
    types = data_types(table, row_id)
    numeric = [n for n in gaps if is_numeric(types[n])]
    times = [n for n in gaps if is_temporal(types[n])]
    others = [n for n in gaps if n not in numeric and n not in times and is_fillable(types[n])]
    missing = {}
    if gaps:
        row = table.agg(*[count_if(col(n).isNull()).alias(f"m{i}") for i, n in enumerate(gaps)]).first()
        missing = {n: row[f"m{i}"] for i, n in enumerate(gaps)}
    quantiles = approx_quantiles if approx else partial(exact_quantiles, rows=rows)
    medians = quantiles(table, {n: (0.5,) for n in numeric}) if numeric else {}
    values: dict[str, object] = {n: q[0.5] for n, q in medians.items()}
    for n, v in (modes(table, others) if others else {}).items():
        values[n] = "" if v is None and is_text(types[n]) else v
    total = 0
    for n, v in values.items():
        if v is not None:
            total += missing[n]
            how = "fill_median" if n in numeric else "fill_mode"
            log.add(n, how, missing[n], value=str(v), message=f"Filled {missing[n]} gaps in '{n}' with {v!r}.")
    table = c.fill_value(table, values)
    if times:
        table = c.fill_forward(table, times, row_id)
        for n in times:
            if missing[n] < rows:
                total += missing[n]
                log.add(n, "fill_forward", missing[n], message=f"Filled {missing[n]} gaps in '{n}' forward.")
    return table, total


def cleaning_advice(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """What an automatic run would do: (position, advice, column_name, amount).

    One wide `agg` counts every condition; duplicates come from `table_stats`.
    """
    df = nan_to_null(df)
    types = data_types(df, row_id)
    nothing = F.lit(None).cast("string")
    aggregates = [count_if(_all_missing(types)).alias("empty")]
    entries = [[F.lit(1), F.lit("remove empty rows"), nothing, F.col("empty")]]
    renames = sum(a != b for a, b in zip(types, snake_case_labels(list(types))))
    entries.append([F.lit(2), F.lit("rename columns"), nothing, F.lit(renames).cast("bigint")])
    for i, (n, t) in enumerate(types.items()):
        position = 3 + 4 * i
        aggregates.append(count_if(col(n).isNull()).alias(f"m{i}"))
        how = "median" if is_numeric(t) else "forward fill" if c.is_date_name(n) else "mode"
        entries.append([F.lit(position), F.lit(f"fill with {how}"), F.lit(n), F.col(f"m{i}")])
        if c.is_date_name(n) and not is_temporal(t) and not is_numeric(t):
            entries.append([F.lit(position + 1), F.lit("parse dates"), F.lit(n), F.lit(1).cast("bigint")])
        if is_text(t) and not c.is_date_name(n):
            parsed = count_if(number_of(col(n)).isNotNull())
            aggregates += [
                count_if(has_extra_spaces(col(n))).alias(f"s{i}"),
                F.when(parsed > 0.9 * F.count(col(n)), parsed).otherwise(0).alias(f"p{i}"),
            ]
            entries.append([F.lit(position + 2), F.lit("trim text"), F.lit(n), F.col(f"s{i}")])
            entries.append([F.lit(position + 3), F.lit("convert to number"), F.lit(n), F.col(f"p{i}")])
    named = [
        [a.alias("position"), b.alias("advice"), d.alias("column_name"), e.alias("amount")]
        for a, b, d, e in entries
    ]
    found = per_column(df.agg(*aggregates), named)
    copies = table_stats(df, row_id).select(
        F.lit(0).alias("position"),
        F.lit("remove duplicates").alias("advice"),
        nothing.alias("column_name"),
        F.col("duplicate_rows").alias("amount"),
    )
    clean = F.struct(
        F.lit(0).alias("position"),
        F.lit("nothing to clean").alias("advice"),
        nothing.alias("column_name"),
        F.lit(0).cast("bigint").alias("amount"),
    )
    return or_else(found.unionByName(copies).where("amount > 0"), clean).orderBy("position")


def _all_missing(types: dict):
    condition = F.lit(True)
    for n in types:
        condition = condition & col(n).isNull()
    return condition
