"""Reading tables: CSV with inferred types, parquet, basic checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.columns import col, count_if, is_text, nan_to_null
from ..functions.storage import materialise
from ..functions.text import INTEGER_TEXT, number_of, numeric_text
from .records import records

_CORRUPT = "_tw_corrupt"
MAX_LISTED = 1000  # files with quoted line breaks that a plan may name


class TableError(ValueError):
    """The table cannot be used."""


def load_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A parquet table; column choice and filters reach the scan."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[col(c) for c in columns])


def blank_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whitespace-only text becomes NULL, and so does NaN."""
    df = nan_to_null(df)
    chosen = {
        f.name for f in df.schema.fields if is_text(f.dataType) and (columns is None or f.name in columns)
    }
    return df.select(
        *[
            F.when(~col(n).rlike(r"(?U)^\s*$"), col(n)).alias(n) if n in chosen else col(n)
            for n in df.columns
        ]
    )


def validate_table(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """The table itself, or `TableError` if it is empty or wider than `max_columns`, if given."""
    if max_columns is not None and len(df.columns) > max_columns:
        raise TableError(f"{len(df.columns)} columns, at most {max_columns} are allowed")
    if not df.columns or df.isEmpty():
        raise TableError("the table is empty")
    return df


def load_csv(
    spark: SparkSession,
    path: str,
    infer: bool = True,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header line; lines with too many fields are left out.

    Short lines are filled with NULL, the usual missing-value words and blank
    cells become NULL, and a column gets a number or boolean type when all its
    values have that form. Dates stay text. Files with other headers than the first
    one raise `TableError`. By default one scan over the lines decides, for each file,
    whether quoted fields contain line breaks; such files are read in splits, too, and
    records are resolved at the edges (`records`). `multi_line=True` parses each file in one
    task instead, and so does a file that mixes quoted breaks with bare carriage returns.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("quote", '"')
    names = reader.csv(path).columns
    facts = _file_facts(spark, path)
    headers = facts.where("header IS NOT NULL").groupBy("header").count().orderBy("header").limit(2).collect()
    if len(headers) > 1:
        raise TableError(f"files with different headers: {headers[0].header!r}, {headers[1].header!r}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    parsing = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "multiLine": True}

    def cells(raw: DataFrame) -> DataFrame:
        outside_quotes = F.regexp_replace(F.col(_CORRUPT), r'"([^"]|"")*"', "")
        too_many = F.col(_CORRUPT).isNotNull() & (F.size(F.split(outside_quotes, ",", -1)) > len(names))
        return raw.where(~too_many).select(
            *[F.when(~col(n).isin(fv.NA_TOKENS), col(n)).alias(n) for n in names]
        )

    def files(paths: str | list[str], multi: bool) -> DataFrame:
        # Field counts are only checked on whole lines, so columns are not pruned.
        return reader.schema(schema).options(**parsing | {"multiLine": multi}, columnPruning=False).csv(paths)

    if multi_line is not None:
        rows = cells(files(path, multi_line))
        return blank_to_null(_typed(rows) if infer else rows)

    broken = facts.where("breaks").select("file", "bare").limit(MAX_LISTED + 1).collect()
    whole = [f.file for f in broken if f.bare]
    if len(broken) > MAX_LISTED:  # too many to name: all go the same way
        whole = [f.file for f in facts.where("breaks AND bare").select("file").collect()]
    listed = [f.file for f in broken] if len(broken) <= MAX_LISTED else None
    parts = []
    if not broken:
        parts.append(cells(files(path, False)))
    else:
        name = F.col("_metadata.file_path")
        if listed is not None:
            parts.append(cells(files(path, False).where(~name.isin(listed))))
        split = ~name.isin(whole) if listed is None else name.isin([f for f in listed if f not in whole])
        if listed is None or len(listed) > len(whole):
            options = {"quote": '"', "escape": '"', **{k: str(v) for k, v in parsing.items()}}
            found = records(_lines(spark, path).where(split))
            parsed = found.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
            parts.append(cells(parsed.select("r.*")))
        if whole:
            parts.append(cells(files(whole, True)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return blank_to_null(_typed(rows) if infer else rows)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines between line feeds, with their file, the start of their split
    in it, and an id that grows within the split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def _file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, breaks, bare) of each file, in one scan: its first line; whether some line has
    an odd number of quotes, so that a quoted field may go on in the next line; whether lines
    may also end in a bare carriage return."""

    def odd(text):
        return (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1

    bare = F.col("value").rlike(r"\r[^\r]")
    lines = _lines(spark, path).select(
        "file", F.when(F.col("block") == 0, F.col("at")).alias("at"), bare.alias("bare"),
        F.when(bare, F.exists(F.split("value", "\r"), odd)).otherwise(odd(F.col("value"))).alias("odd"),
        F.regexp_extract("value", r"\A[^\r]*", 0).alias("value"),
    )
    facts = lines.groupBy("file").agg(
        F.rtrim(F.min_by("value", "at")).alias("header"), F.max("odd").alias("breaks"), F.max("bare").alias("bare")
    )
    return materialise(facts)


def _typed(df: DataFrame) -> DataFrame:
    """Give each text column the type all of its values have; one pass decides."""
    names = df.columns
    words = [F.lower(col(n)).isin("true", "false") for n in names]
    row = df.agg(
        *[
            expr
            for i, n in enumerate(names)
            for expr in (
                F.count(col(n)).alias(f"n{i}"),
                count_if(col(n).rlike(INTEGER_TEXT) & col(n).try_cast("bigint").isNotNull()).alias(f"i{i}"),
                count_if(numeric_text(col(n))).alias(f"f{i}"),
                count_if(words[i]).alias(f"b{i}"),
            )
        ]
    ).first()
    chosen = []
    for i, n in enumerate(names):
        filled = row[f"n{i}"]
        if filled and row[f"i{i}"] == filled:
            chosen.append(F.trim(col(n)).try_cast("bigint").alias(n))
        elif filled and row[f"f{i}"] == filled:
            chosen.append(number_of(col(n)).alias(n))
        elif filled and row[f"b{i}"] == filled:
            chosen.append((F.lower(col(n)) == "true").alias(n))
        else:
            chosen.append(col(n))
    return df.select(*chosen)
