"""Apply exactly what a user approved, and record every step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ROW_ID, col, count_if, data_types, is_fillable, is_numeric, nan_to_null
from ..functions.frequencies import modes
from ..functions.quantiles import exact_quantiles
from ..functions.storage import materialise
from ..operators.cleaning import drop_duplicates_first, drop_empty_rows, interpolate
from ..operators.ordering import with_row_id
from ..operators.profile import quality_score
from ..operators.treatments import (
    IMPUTATIONS,
    OUTLIER_ACTIONS,
    SEGMENT_ACTIONS,
    fill_constant,
    impute_with,
    iqr_bounds,
    segment_outlier_rows,
    treat_segments,
    treat_with,
    written_bounds,
)
from .audit import SKIPPED, AuditLog


@dataclass
class ApprovedResult:
    table: DataFrame
    audit: DataFrame


def apply_cleaning(
    df: DataFrame, config: dict, row_id: str | None = None, order_by: Sequence[str] = ()
) -> ApprovedResult:
    """Duplicates, empty rows, imputations, then outlier actions in the given order.

    `config` has `remove_duplicates`, `remove_empty_rows`, `missing_actions`
    {column: action} and `outlier_actions` {column: action}. A column that was
    not approved carries the action "skip". `interpolate` weighs by rows, or by the column
    that `interpolate_by` names. Forward fill and interpolation need row ids: without
    `row_id` they are attached in `order_by` or file order and stay in the result.
    """
    df = nan_to_null(df)
    if row_id is None and {"ffill", "interpolate"} & set(config.get("missing_actions", {}).values()):
        row_id = ROW_ID
        df = with_row_id(df, order_by, row_id)
    log = AuditLog()
    df = _drop_rows(df, config, row_id, log)
    df = _impute(df, config.get("missing_actions", {}), row_id or ROW_ID, log, config.get("interpolate_by"))
    df = _treat(df, config.get("outlier_actions", {}), log)
    return ApprovedResult(df, log.frame(df.sparkSession))


def _drop_rows(df, config, row_id, log):
    rows = None
    for step, key, what in (
        (drop_duplicates_first, "remove_duplicates", "duplicate rows"),
        (drop_empty_rows, "remove_empty_rows", "empty rows"),
    ):
        name = key.replace("remove_", "drop_")
        if not config.get(key):
            log.add(None, name, status=SKIPPED, message=f"Removal of {what} was not approved.")
            continue
        before = df.count() if rows is None else rows
        after_frame = step(df, row_id)
        if step is drop_duplicates_first:
            after_frame = materialise(after_frame)  # one shuffle, read by all later passes
        rows = after_frame.count()
        removed, df = before - rows, after_frame
        if removed:
            log.add(None, name, removed, message=f"Removed {removed} {what}.")
        else:
            log.add(None, name, status=SKIPPED, message=f"There were no {what}.")
    return df


def _impute(df, actions, row_id, log, by=None):
    types = data_types(df, row_id)
    actions = {n: a for n, a in actions.items() if n in types}
    if not actions:
        return df
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[count_if(col(n).isNull()).alias(f"m{i}") for i, n in enumerate(actions)]
    ).first()
    gaps = {n: row[f"m{i}"] for i, n in enumerate(actions) if row[f"m{i}"]}
    actions = {n: a for n, a in actions.items() if n in gaps}
    values = _constants(df, actions, types, row["n"])
    # One carry for all interpolated columns, from the values that other steps have not touched.
    lines = [n for n, a in actions.items() if a == "interpolate" and is_numeric(types[n]) and gaps[n] < row["n"]]
    df = interpolate(df, lines, row_id, by)
    for n, action in actions.items():
        value, amount = values.get(n), gaps[n]
        if action == "interpolate":
            if n in lines:
                log.add(n, action, amount, message=f"Filled {amount} missing values of '{n}' ({action}).")
            else:
                log.add(n, action, status=SKIPPED, message=f"'{n}' has no numbers to interpolate.")
            continue
        if action == "keep_null":
            log.add(n, action, amount, message=f"Kept {amount} missing values of '{n}'.")
        elif action not in IMPUTATIONS:
            log.add(n, action, status=SKIPPED, message=f"{amount} missing values of '{n}' were left alone.")
        elif action in ("ffill", "indicator") or value is not None:
            df = impute_with(df, n, action, value, row_id)
            log.add(n, action, amount, value=None if value is None else str(value),
                    message=f"Filled {amount} missing values of '{n}' ({action}).")
    return df


def _constants(df, actions, types, rows):
    """Fill values of all columns, with medians and means in shared passes."""
    medians = [
        n for n, a in actions.items() if a == "median" or (a == "indicator" and is_numeric(types[n]))
    ]
    means = [n for n, a in actions.items() if a == "mean"]
    frequent = [
        n
        for n, a in actions.items()
        if is_fillable(types[n]) and (a == "mode" or (a == "indicator" and not is_numeric(types[n])))
    ]
    values = {n: q[0.5] for n, q in exact_quantiles(df, {n: (0.5,) for n in medians}, rows=rows).items()}
    if means:
        row = df.agg(*[F.avg(col(n).cast("double")).alias(f"a{i}") for i, n in enumerate(means)]).first()
        values |= {n: row[f"a{i}"] for i, n in enumerate(means)}
    if frequent:
        values |= modes(df, frequent)
    for n, action in actions.items():
        if action in ("na_string", "indicator") and values.get(n) is None and is_fillable(types[n]):
            values[n] = fill_constant(df, n, action)
    return values


def _treat(df, actions, log):
    types = data_types(df)
    pending = [(n, a) for n, a in actions.items() if n in types and is_numeric(types[n])]
    while pending:
        # Bounds only change when rows were removed, so all columns up to and
        # including the next removal share their passes.
        if isinstance(pending[0][1], (tuple, list)):
            (n, (action, by)), *pending = pending
            df = _treat_segments(df, n, action, by, log)
            continue
        stop = next((i for i, (_, a) in enumerate(pending) if isinstance(a, (tuple, list))), len(pending))
        cut = next((i for i, (_, a) in enumerate(pending[:stop]) if a == "remove"), stop - 1)
        batch, pending = pending[: cut + 1], pending[cut + 1 :]
        bounds = iqr_bounds(df, [n for n, _ in batch], medians=[n for n, a in batch if a == "rescale"])
        known = [(n, a) for n, a in batch if bounds[n] is not None]
        if not known:
            continue
        row = df.agg(*[count_if(bounds[n].concerns(n, a)).alias(f"o{i}") for i, (n, a) in enumerate(known)]).first()
        for i, (n, action) in enumerate(known):
            amount = row[f"o{i}"]
            if not amount:
                continue
            if action not in OUTLIER_ACTIONS:
                log.add(n, action, status=SKIPPED, message=f"{amount} outliers of '{n}' were left alone.")
                continue
            df = treat_with(df, n, action, bounds[n])
            limits = f"{bounds[n].lower:.2f} to {bounds[n].upper:.2f}"
            log.add(n, action, amount, value=limits, message=f"{amount} outliers of '{n}': {action}.")
    return df


def _treat_segments(df, column, action, by, log):
    if by not in df.columns or by == column or action not in SEGMENT_ACTIONS:
        log.add(column, f"{action} by {by}", status=SKIPPED, message=f"Outliers of '{column}' by '{by}' were left alone.")
        return df
    bounds = written_bounds(df, column, by)
    amount = segment_outlier_rows(df, column, by, bounds).count()
    if amount:
        df = treat_segments(df, column, action, by, bounds)
        log.add(column, f"{action} by {by}", amount, message=f"{amount} outliers of '{column}' within '{by}': {action}.")
    return df


def cleaning_comparison(before: DataFrame, after: DataFrame, row_id: str | None = None) -> DataFrame:
    """Rows and quality score before and after."""
    old = quality_score(before, row_id).select(
        F.col("row_count").alias("rows_before"), F.col("quality_score").alias("score_before")
    )
    new = quality_score(after, row_id).select(F.struct("row_count", "quality_score").alias("now"))
    return old.withColumn("now", new.scalar()).select(
        "rows_before", F.col("now.row_count").alias("rows_after"),
        "score_before", F.col("now.quality_score").alias("score_after"),
    )
