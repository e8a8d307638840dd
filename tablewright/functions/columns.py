"""Type classes and small column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "_row_id"

_FLOATS = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_numeric(dtype: T.DataType) -> bool:
    """Integers, floats and decimals; booleans are not numbers here."""
    return isinstance(dtype, T.NumericType)


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_category(dtype: T.DataType) -> bool:
    """Neither number, boolean nor date: values that name a segment."""
    return not is_numeric(dtype) and not is_boolean(dtype) and not is_temporal(dtype)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLOATS + (T.DecimalType,))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TIMES)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def is_fillable(dtype: T.DataType) -> bool:
    """Values that a most frequent one can stand in for: no nested ones, no intervals."""
    return not is_nested(dtype) and not isinstance(
        dtype, (T.CalendarIntervalType, T.DayTimeIntervalType, T.YearMonthIntervalType)
    )


def quoted(name: str) -> str:
    """A column label in SQL text, dots and blanks included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact label, dots and blanks included."""
    return F.col(quoted(name))


def double(value: float) -> str:
    """A double in SQL text, exact."""
    if value != value or value in (float("inf"), float("-inf")):
        return f"double('{value}')"
    return f"{value!r}D" if value >= 0 else f"(-{-value!r}D)"


def text_literal(value: str) -> str:
    """A string in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dtypes(df: DataFrame, exclude: Iterable[str] = ()) -> dict[str, T.DataType]:
    """Label -> type of the data columns, in table order."""
    skip = set(exclude)
    return {f.name: f.dataType for f in df.schema.fields if f.name not in skip}


def data_types(df: DataFrame, row_id: str | None = None) -> dict[str, T.DataType]:
    """`dtypes` without the row id, whether it is named or the default one."""
    return dtypes(df, {ROW_ID, row_id} if row_id else {ROW_ID})


def name_has(name: str, words: Sequence[str]) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in words)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL are one kind of missing: keep NULL."""
    floats = {f.name: f.dataType.simpleString() for f in df.schema.fields if isinstance(f.dataType, _FLOATS)}
    if not floats:
        return df
    return df.selectExpr(
        *[
            f"nanvl({quoted(n)}, CAST(NULL AS {floats[n]})) AS {quoted(n)}" if n in floats else quoted(n)
            for n in df.columns
        ]
    )


def text_sql(name: str, dtype: T.DataType) -> str:
    """SQL for text that is equal exactly when two values of the column are equal."""
    value = quoted(name)
    if isinstance(dtype, T.ArrayType):
        return f"to_json(struct({value}))"
    if is_nested(dtype):
        return f"to_json({value})"
    if isinstance(dtype, _FLOATS):
        return f"CAST({value} + 0.0D AS STRING)"  # -0.0 and 0.0 are one value
    if isinstance(dtype, T.BinaryType):
        return f"hex({value})"
    return value if is_text(dtype) else f"CAST({value} AS STRING)"


def as_text(name: str, dtype: T.DataType) -> Column:
    """`text_sql` as a column."""
    return F.expr(text_sql(name, dtype))


def short_key(text: str, limit: int = 64) -> str:
    """SQL for the text itself, or its SHA-256 digest when it is longer than a digest.

    Raw texts kept here are at most `limit` characters; digests carry a prefix
    that makes them longer, so a text and a digest never meet.
    """
    return f"CASE WHEN length({text}) <= {limit} THEN {text} ELSE concat('#', sha2({text}, 256)) END"


def row_digest(types: dict[str, T.DataType]) -> Column:
    """SHA-256 over all columns, NULL kept apart from every text.

    Grouping whole rows by 32 bytes instead of by every column keeps the shuffle
    small for wide tables and long texts.
    """
    texts = [text_sql(n, t) for n, t in types.items()]
    parts = [f"coalesce(concat(length({x}), ':', {x}), '-')" for x in texts]
    return F.expr(f"unhex(sha2(concat_ws(',', {', '.join(parts)}), 256))")


def row_key(types: dict[str, T.DataType], widest: int = 24) -> list[Column]:
    """Grouping columns that are equal for equal rows.

    A narrow table groups by its values, long texts shortened to digests; a wide
    one by a single digest, so that a key never outgrows a few hundred bytes.
    """
    if len(types) > widest:
        return [row_digest(types).alias("k0")]
    keys = []
    for i, (n, t) in enumerate(types.items()):
        fixed = isinstance(t, (T.NumericType, T.BooleanType) + _TIMES)
        keys.append((col(n) if fixed else F.expr(short_key(text_sql(n, t)))).alias(f"k{i}"))
    return keys


def missing_cells(names: Iterable[str]) -> Column:
    """Number of NULL cells in a row."""
    return F.expr(" + ".join(["0", *[f"CAST({quoted(n)} IS NULL AS INT)" for n in names]]))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def per_column(frame: DataFrame, entries: Sequence[Sequence[Column]]) -> DataFrame:
    """Turn a one-row frame into one row per entry (the inverse of a wide `agg`)."""
    return frame.select(F.inline(F.array(*[F.struct(*entry) for entry in entries])))
