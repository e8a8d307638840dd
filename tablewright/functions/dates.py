"""Dates in text. Spark reads only ISO-like text without a format, so formats are tried."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ROW_ID, col

DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyyMMdd",
    "M/d/yyyy",
    "d/M/yyyy",
    "M-d-yyyy",
    "d-M-yyyy",
    "M.d.yyyy",
    "d.M.yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "M/d/yyyy HH:mm:ss",
    "d/M/yyyy HH:mm:ss",
]


def parse_with(text: Column, formats: Sequence[str]) -> Column:
    """The timestamp by the first format that fits, NULL when none does."""
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tried) if len(tried) > 1 else tried[0]


def leading_formats(
    df: DataFrame, names: Sequence[str], row_id: str = ROW_ID, formats: Sequence[str] = DATE_FORMATS
) -> Mapping[str, str | None]:
    """The format of the first value of each column; one row reaches the driver."""
    if not names:
        return {}
    firsts = df.agg(
        *[F.min_by(col(n), F.when(col(n).isNotNull(), col(row_id))).alias(f"t{i}") for i, n in enumerate(names)]
    )
    row = firsts.select(
        *[
            F.coalesce(
                *[F.when(F.try_to_timestamp(F.col(f"t{i}"), F.lit(f)).isNotNull(), F.lit(f)) for f in formats]
            ).alias(f"f{i}")
            for i in range(len(names))
        ]
    ).first()
    return {n: row[f"f{i}"] for i, n in enumerate(names)}
