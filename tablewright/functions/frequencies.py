"""Distinct counts, small value sets and modes through one (column, value) shuffle.

Several `count_distinct` in one `agg` make Spark expand every row once per column
and keep the distinct sets together; here the columns are unpivoted, equal
values collapse before the shuffle, and (column, value) spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, data_types, is_text, quoted, short_key, text_literal, text_sql

CLEARLY_MANY = 1000


def unpivot(df: DataFrame, names: Sequence[str], digest_long: bool = True) -> DataFrame:
    """(column_name, value) with every value as text, NULL values left out."""
    types = data_types(df)
    shorten = short_key if digest_long else (lambda text: text)
    wide = df.selectExpr(*[f"{shorten(text_sql(n, types[n]))} AS c{i}" for i, n in enumerate(names)])
    labels = F.expr(
        "map(" + ", ".join(f"'c{i}', {text_literal(n)}" for i, n in enumerate(names)) + ")[column_name]"
    )
    if len(names) == 1:
        long = wide.select(F.lit("c0").alias("column_name"), F.col("c0").alias("value"))
    else:
        long = wide.unpivot([], [f"c{i}" for i in range(len(names))], "column_name", "value")
    return long.where(F.col("value").isNotNull()).withColumn("column_name", labels)


def _family(dtype: T.DataType) -> str:
    """The type under which a column is compared; equal values stay equal."""
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return dtype.simpleString()
    return "string"


def distinct_counts(df: DataFrame, names: Sequence[str], approx: bool = False) -> DataFrame:
    """(column_name, unique_count) for columns with at least one value.

    Columns of one family are stacked together, so numbers and dates keep their
    fixed-width form and only texts travel as text.
    """
    types = data_types(df)
    if approx:
        wide = df.selectExpr(*[f"approx_count_distinct({quoted(n)}) AS d{i}" for i, n in enumerate(names)])
        return wide.selectExpr(
            "inline(array(" + ", ".join(
                f"named_struct('column_name', {text_literal(n)}, 'unique_count', d{i})" for i, n in enumerate(names)
            ) + "))"
        ).where("unique_count > 0")
    families: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        families.setdefault(_family(types[n]), []).append(i)
    counted = []
    for family, members in families.items():
        cells = []
        for i in members:
            n = names[i]
            value = short_key(text_sql(n, types[n])) if family == "string" else f"CAST({quoted(n)} AS {family})"
            cells.append(f"{i}, {value}")
        long = df.selectExpr(f"stack({len(members)}, {', '.join(cells)}) AS (place, value)")
        counted.append(
            long.where("value IS NOT NULL")
            .groupBy("place", "value")
            .agg(F.lit(1).alias("one"))
            .groupBy("place")
            .agg(F.count(F.lit(1)).alias("unique_count"))
        )
    labels = f"array({', '.join(map(text_literal, names))})[place]"
    return reduce(DataFrame.unionAll, counted).selectExpr(f"{labels} AS column_name", "unique_count")


def small_value_sets(df: DataFrame, names: Sequence[str], limit: int) -> dict[str, list[str]]:
    """Values of the columns with at most `limit` distinct ones; exact.

    A sketch first sets aside columns with clearly more values, so only small
    sets are grouped and returned (at most `limit` texts per column).
    """
    if not names:
        return {}
    row = df.selectExpr(*[f"approx_count_distinct({quoted(n)}) AS d{i}" for i, n in enumerate(names)]).first()
    likely = [n for i, n in enumerate(names) if row[f"d{i}"] <= max(CLEARLY_MANY, 2 * limit)]
    if not likely:
        return {}
    types = data_types(df)
    counts = {r["column_name"]: r["unique_count"] for r in distinct_counts(df, likely).collect()}
    small = [n for n in likely if 0 < counts.get(n, 0) <= limit]
    found: dict[str, list[str]] = {n: [] for n in likely if not counts.get(n)}  # no value at all
    if small:
        values = unpivot(df, small, digest_long=False).groupBy("column_name", "value").agg(F.lit(1).alias("one"))
        sets = values.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("vs"))
        found |= {r["column_name"]: r["vs"] for r in sets.collect()}
    return {n: found[n] for n in types if n in found}


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one on ties, None if no value."""
    types: Mapping[str, T.DataType] = data_types(df)
    texts = [n for n in names if is_text(types[n])]
    result: dict[str, object] = {n: None for n in names}
    if texts:
        best = (
            unpivot(df, texts, digest_long=False)
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("column_name")
            .agg(F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("best"))
        )
        for r in best.collect():
            result[r["column_name"]] = r["best"]["value"]
    others = [n for n in names if n not in texts]
    if others:
        # One grouping for all: a cell holds the column's place and its value in the column's own slot.
        def cell(i: int) -> str:
            slots = [
                f"'v{j}', {quoted(n) if j == i else f'CAST(NULL AS {types[n].simpleString()})'}"
                for j, n in enumerate(others)
            ]
            return f"CASE WHEN {quoted(others[i])} IS NOT NULL THEN named_struct('place', {i}, {', '.join(slots)}) END"

        slots = [f"v{j}" for j in range(len(others))]
        cells = df.selectExpr(f"explode(array({', '.join(map(cell, range(len(others))))})) AS c").where("c IS NOT NULL")
        best = (
            cells.groupBy("c.place", *[f"c.{v}" for v in slots])
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("place")
            .agg(F.min(F.struct((-F.col("n")).alias("less"), *slots)).alias("best"))
        )
        for r in best.collect():
            result[others[r["place"]]] = r["best"][f"v{r['place']}"]
    return result
