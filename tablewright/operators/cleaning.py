"""Cleaning steps, each usable alone. The full run is `plans.automatic`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.columns import (
    is_fillable,
    ROW_ID,
    col,
    count_if,
    data_types,
    is_numeric,
    is_temporal,
    is_text,
    name_has,
    nan_to_null,
)
from ..functions.dates import leading_formats, parse_with
from ..functions.frequencies import modes
from ..functions.quantiles import approx_quantiles, exact_quantiles
from ..functions.text import INTEGER_TEXT, number_of, snake_case_labels, squeeze
from .ordering import carry_both, carry_last


def is_date_name(name: str) -> bool:
    return name_has(name, fv.DATE_NAME_WORDS)


def replace_columns(df: DataFrame, new: dict) -> DataFrame:
    """Swap columns in place, keeping their order."""
    return df.select(*[new[n].alias(n) if n in new else col(n) for n in df.columns])


def drop_empty_rows(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Drop rows in which every data column is missing."""
    df = nan_to_null(df)
    return df.dropna(how="all", subset=["`" + n.replace("`", "``") + "`" for n in data_types(df, row_id)])


def drop_duplicates_first(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Keep the first of equal rows.

    Equal rows differ in nothing but their id, so a grouping with `min(id)`
    keeps the first one and combines copies before the shuffle.
    """
    df = nan_to_null(df)
    if row_id is None:
        # grouping compares maps by value, which dropDuplicates refuses
        return df.groupBy(*[col(n) for n in df.columns]).agg(F.count(F.lit(1)).alias("_tw_n")).drop("_tw_n")
    keys = [col(n) for n in df.columns if n != row_id]
    kept = df.groupBy(*keys).agg(F.min(col(row_id)).alias(row_id))
    return kept.select(*[col(n) for n in df.columns])


def snake_case_columns(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Rename all data columns to snake_case; clashes get a number."""
    types = data_types(df, row_id)
    new = dict(zip(types, snake_case_labels(list(types))))
    return df.toDF(*[new.get(n, n) for n in df.columns])


def text_columns(df: DataFrame, row_id: str | None = None) -> list[str]:
    """Text columns that are not treated as dates."""
    return [n for n, t in data_types(df, row_id).items() if is_text(t) and not is_date_name(n)]


def trim_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip text and replace runs of whitespace by one space."""
    chosen = text_columns(df) if columns is None else columns
    return replace_columns(df, {n: squeeze(col(n)) for n in chosen})


def date_columns(df: DataFrame, row_id: str | None = None) -> list[str]:
    """Columns whose name promises a date but whose type is text or a number."""
    return [
        n for n, t in data_types(df, row_id).items() if is_date_name(n) and (is_text(t) or is_numeric(t))
    ]


def parse_dates(
    df: DataFrame,
    row_id: str = ROW_ID,
    columns: Sequence[str] | None = None,
    formats: Sequence[str] | None = None,
) -> DataFrame:
    """Turn date-named columns into timestamps; what does not parse becomes NULL.

    Without `formats` the first value of a text column sets its one format; with
    `formats` each value takes the first format that fits. Numbers count
    nanoseconds since 1970.
    """
    chosen = date_columns(df, row_id) if columns is None else list(columns)
    types = data_types(df)
    texts = [n for n in chosen if is_text(types[n])]
    new = {
        n: F.timestamp_micros((col(n) / 1000).cast("bigint")).cast("timestamp_ntz")
        for n in chosen
        if is_numeric(types[n])
    }
    if formats is not None:
        new |= {n: parse_with(col(n), formats) for n in texts}
    else:
        found = leading_formats(df, texts, row_id)
        nothing = F.lit(None).cast("timestamp_ntz")
        new |= {n: parse_with(col(n), [found[n]]) if found[n] else nothing for n in texts}
    return replace_columns(df, new)


def numeric_text_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Text columns in which more than 90 % of the values are numbers -> new type."""
    if not columns:
        return {}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(columns):
        value = number_of(col(n))
        aggregates += [
            F.count(col(n)).alias(f"n{i}"),
            count_if(value.isNotNull()).alias(f"p{i}"),
            count_if(col(n).rlike(INTEGER_TEXT) & F.trim(col(n)).try_cast("bigint").isNotNull()).alias(f"i{i}"),
        ]
    row = df.agg(*aggregates).first()
    found = {}
    for i, n in enumerate(columns):
        filled, parsed, whole = row[f"n{i}"], row[f"p{i}"], row[f"i{i}"]
        if filled > 0 and parsed > fv.NUMERIC_TEXT_SHARE * filled:
            # whole numbers stay whole only while nothing in the column is missing
            found[n] = "bigint" if whole == row["rows"] else "double"
    return found


def to_number(name: str, dtype: str):
    return F.trim(col(name)).try_cast("bigint") if dtype == "bigint" else number_of(col(name))


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Give number types to text that is mostly numbers; the rest of it becomes NULL."""
    found = numeric_text_columns(df, text_columns(df) if columns is None else columns)
    return replace_columns(df, {n: to_number(n, t) for n, t in found.items()})


def fill_value(df: DataFrame, values: dict) -> DataFrame:
    """Replace NULL by a constant per column; integers become double for a fraction."""
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {}
    for n, value in values.items():
        if value is None:
            continue
        base = col(n).cast("double") if is_numeric(types[n]) and isinstance(value, float) else col(n)
        new[n] = F.coalesce(base, F.lit(value))
    return replace_columns(df, new)


def fill_median(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Fill numeric columns with their median (exact and interpolated by default)."""
    df = nan_to_null(df)
    types = data_types(df)
    chosen = [n for n, t in types.items() if is_numeric(t)] if columns is None else list(columns)
    quantiles = (approx_quantiles if approx else exact_quantiles)(df, {n: (0.5,) for n in chosen})
    return fill_value(df, {n: q[0.5] for n, q in quantiles.items()})


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill with the most frequent value (smallest on ties); empty text if there is none."""
    types = data_types(df)
    if columns is None:
        columns = [n for n, t in types.items() if not is_numeric(t) and not is_temporal(t) and is_fillable(t)]
    found = modes(df, columns)
    return fill_value(
        df, {n: "" if v is None and is_text(types[n]) else v for n, v in found.items()}
    )


def fill_forward(
    df: DataFrame, columns: Sequence[str], row_id: str = ROW_ID, block_rows: int | None = None
) -> DataFrame:
    """Fill with the last value in row order; rows before the first value take that one."""
    if not columns:
        return df
    names = {f"_tw_f{i}": n for i, n in enumerate(columns)}
    firsts = df.agg(
        *[F.min_by(col(n), F.when(col(n).isNotNull(), col(row_id))).alias(f) for f, n in names.items()]
    ).first()
    carried = carry_last(df, {f: col(n) for f, n in names.items()}, row_id, block_rows=block_rows)
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {n: F.coalesce(F.col(f), F.lit(firsts[f]).cast(types[n])) for f, n in names.items()}
    return replace_columns(carried, new).select(*[col(n) for n in df.columns])


def interpolate(
    df: DataFrame,
    columns: Sequence[str],
    row_id: str = ROW_ID,
    by: str | None = None,
    edges: bool = True,
    block_rows: int | None = None,
) -> DataFrame:
    """Fill gaps of numeric columns on the straight line between the values around them.

    Places are the row ids, or the values of `by` (a number, date or timestamp): then rows
    without a place neither give values nor are filled, and between equal places the
    earlier row's value counts. Before the first and after the last value the nearest
    one is taken; with `edges` off such gaps stay. Filled columns become doubles.
    """
    if not columns:
        return df
    place = col(row_id).cast("double")
    if by is not None:
        dtype = data_types(df)[by]
        moment = isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))
        place = (F.unix_micros(col(by).cast("timestamp")) if moment else col(by)).cast("double")
    names = {f"_tw_i{i}": n for i, n in enumerate(columns)}
    value = {x: F.nanvl(col(n).cast("double"), F.lit(None).cast("double")) for x, n in names.items()}
    wanted = {
        x: F.when(v.isNotNull() & place.isNotNull(), F.struct(v.alias("v"), place.alias("p"))) for x, v in value.items()
    }
    around = carry_both(df, wanted, row_id, block_rows)
    new = {}
    for x, n in names.items():
        before, after = F.col(f"{x}_before"), F.col(f"{x}_after")
        share = F.try_divide(place - before["p"], after["p"] - before["p"])
        line = before["v"] + (after["v"] - before["v"]) * F.coalesce(share, F.lit(0.0))
        nearest = F.coalesce(before["v"], after["v"]) if edges else F.lit(None).cast("double")
        filled = F.when(before.isNotNull() & after.isNotNull(), line).otherwise(nearest)
        new[n] = F.when(value[x].isNull() & place.isNotNull(), filled).otherwise(value[x])
    return replace_columns(around, new).select(*[col(n) for n in df.columns])
