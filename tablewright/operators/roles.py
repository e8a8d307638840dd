"""What each column is for: date, flag, identifier, number or category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import (
    col,
    data_types,
    is_boolean,
    is_float,
    is_numeric,
    is_temporal,
    is_text,
    name_has,
    nan_to_null,
)
from ..functions.dates import DATE_FORMATS, parse_with
from ..functions.frequencies import distinct_counts, small_value_sets
from .ordering import with_places

DATE, BOOLEAN, IDENTIFIER = "Date/Time", "Boolean", "Identifier"
NUMERICAL, CATEGORICAL = "Numerical", "Categorical"


def infer_roles(df: DataFrame, row_id: str | None = None) -> dict[str, str]:
    """Column -> role, in table order; the first matching rule decides."""
    df = nan_to_null(df)
    types = data_types(df, row_id)
    roles = {n: DATE for n, t in types.items() if is_temporal(t)}
    promised = [n for n in types if n not in roles and name_has(n, fv.ROLE_DATE_WORDS)]
    roles |= {n: DATE for n in _readable_dates(df, promised, types, row_id)}
    open_columns = [n for n in types if n not in roles]
    small = small_value_sets(df, open_columns, 2)
    for n in open_columns:
        words = {v.lower() for v in small[n]} if n in small else {"more than two"}
        if is_boolean(types[n]) or words <= set(fv.BOOLEAN_WORDS):
            roles[n] = BOOLEAN
    named = [
        n
        for n in types
        if n not in roles and name_has(n, fv.ROLE_ID_WORDS) and not is_float(types[n])
    ]
    roles |= {n: IDENTIFIER for n in named if "id" in n.lower()}
    roles |= {n: IDENTIFIER for n in _mostly_distinct(df, [n for n in named if n not in roles])}
    for n, t in types.items():
        roles.setdefault(n, NUMERICAL if is_numeric(t) else CATEGORICAL)
    return {n: roles[n] for n in types}


def _readable_dates(df, names, types, row_id) -> list[str]:
    """Date-named columns of which one of the first ten values reads as a date; without a row
    id the first ones are those in input order."""
    places = [col(row_id)] if row_id else None
    if places is None and any(is_text(types[n]) for n in names):
        df, at = with_places(df)
        places = [F.col(c) for c in at]
    numbers = [n for n in names if is_numeric(types[n])]  # epoch numbers always read
    texts = [n for n in names if is_text(types[n])]
    heads = []
    for n in texts:
        filled = df.where(col(n).isNotNull())
        first = filled.orderBy(*places).limit(10)
        heads.append(first.select(F.lit(n).alias("n"), parse_with(col(n), DATE_FORMATS).isNotNull().alias("ok")))
    for n in numbers:
        heads.append(df.where(col(n).isNotNull()).limit(1).select(F.lit(n).alias("n"), F.lit(True).alias("ok")))
    if not heads:
        return []
    rows = reduce(DataFrame.unionByName, heads).where("ok").select("n").distinct().collect()
    return [r["n"] for r in rows]


def _mostly_distinct(df: DataFrame, names: list[str]) -> list[str]:
    if not names:
        return []
    rows = df.count()
    counts = distinct_counts(df, names).collect()
    return [r["column_name"] for r in counts if rows and r["unique_count"] / rows > 0.5]


def column_roles(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """(ordinal, column_name, role), one row per column."""
    roles = infer_roles(df, row_id)
    return df.sparkSession.createDataFrame(
        [(i, n, r) for i, (n, r) in enumerate(roles.items())], "ordinal int, column_name string, role string"
    )


def with_role(roles: dict[str, str], role: str) -> list[str]:
    return [n for n, r in roles.items() if r == role]
