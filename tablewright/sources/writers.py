"""Writing cleaned tables and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import col, is_text


def escape_formulas(df: DataFrame) -> DataFrame:
    """Put an apostrophe before text a spreadsheet would run as a formula."""
    starts = "^[" + "".join("\\" + c for c in fv.FORMULA_STARTS) + "]"
    return df.select(
        *[
            F.when(col(f.name).rlike(starts), F.concat(F.lit("'"), col(f.name))).otherwise(col(f.name)).alias(f.name)
            if is_text(f.dataType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def write_clean(
    df: DataFrame,
    path: str,
    file_format: str = "csv",
    row_id: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write a cleaned table as CSV or parquet, formulas escaped.

    With `row_id` the files follow the row order (a range shuffle) and the id is
    not written; without it every task writes its own part as it is.
    """
    if row_id is not None:
        df = df.orderBy(col(row_id)).drop(row_id)
    writer = escape_formulas(df).write.mode(mode)
    if file_format == "csv":
        # blanks around a value belong to it
        writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {file_format!r}")


def audit_lines(audit: DataFrame, dataset_id: str, initial_score: int) -> DataFrame:
    """The audit log as text lines: a header, then one line per step."""
    spark = audit.sparkSession
    header = [
        (-4, "=== Data Cleaning Audit Log ==="),
        (-3, f"File ID: {dataset_id}"),
        (-2, f"Initial Quality Score: {initial_score}/100"),
        (-1, "Applied Changes:"),
    ]
    entries = audit.select(
        F.col("step").alias("line"), F.concat(F.lit("- ["), "status", F.lit("] "), "message").alias("value")
    )
    return spark.createDataFrame(header, "line int, value string").unionByName(entries)


def write_audit(
    audit: DataFrame, path: str, dataset_id: str, initial_score: int, file_format: str = "text"
) -> None:
    """Audit log as one text file, or its rows as JSON. It has one row per approved step."""
    if file_format == "text":
        lines = audit_lines(audit, dataset_id, initial_score).orderBy("line").select("value")
        lines.coalesce(1).write.text(path)
    elif file_format == "json":
        audit.withColumns(
            {"dataset_id": F.lit(dataset_id), "initial_score": F.lit(initial_score)}
        ).write.json(path)
    else:
        raise ValueError(f"unknown format {file_format!r}")
