"""Reading, writing, row order."""

from pyspark.sql import functions as F

from tablewright import sources as src
from tablewright.functions.storage import scratch_path
from tablewright.operators.ordering import with_row_id

from .common import CTE_TEXT, rounded, table, text


def _raw_lines(s, sf):
    """CSV lines made from customers: some too long, some short, some with missing words."""
    c = table(s, sf, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, "N/A").when(k % 13 == 0, "   ").otherwise(F.concat(F.lit('"'), "c_name", F.lit(', ""x"""')))
    full = F.concat_ws(",", k, name, "c_acctbal", F.when(k % 3 == 0, "true").otherwise("False"))
    line = (
        F.when(k % 7 == 0, F.concat(full, F.lit(",extra")))
        .when(k % 5 == 0, F.concat_ws(",", k, name))
        .otherwise(full)
    )
    return c.select(line.alias("value"))


def _load_csv(s, sf):
    path = scratch_path(s, "csv")
    # One column of ready lines; its label becomes the header of every file.
    lines = _raw_lines(s, sf).withColumnRenamed("value", "id,name,balance,flag")
    lines.write.options(
        header=True, sep="\u0001", quote="\u0000", escape="\u0000",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return src.load_csv(s, path)


def _round_trip(s, sf):
    path = scratch_path(s, "clean")
    src.write_clean(src.blank_to_null(text(s, sf)), path, "csv", row_id=None)
    return src.load_csv(s, path)


def _round_trip_parquet(s, sf):
    path = scratch_path(s, "clean")
    src.write_clean(text(s, sf), path, "parquet")
    return src.load_table(s, path)


def _documents(s, sf):
    """Whole texts with line breaks through a CSV file and back."""
    path = scratch_path(s, "documents")
    src.write_clean(table(s, sf, "documents"), path, "csv")
    back = src.load_csv(s, path)
    length, digest = F.length("text").cast("bigint"), F.md5("text")
    return back.select("doc_id", length.alias("length"), digest.alias("digest"), "lang", "source", "n_chars")


def _in_files(s, sf):
    """Parts in three files of very different sizes, numbered in file order."""
    path = scratch_path(s, "files")
    parts = table(s, sf, "part").select("p_partkey", "p_name")
    few = F.col("p_partkey") % 100
    for name, rows in (("a", few == 7), ("b", few > 7), ("c", few < 7)):
        parts.where(rows).coalesce(1).sortWithinPartitions("p_partkey").write.parquet(f"{path}/{name}")
    return with_row_id(s.read.option("recursiveFileLookup", True).parquet(path)).select("_row_id", "p_partkey", "p_name")


QUERIES = {
    "load_table": lambda s, sf: src.load_table(s, f"{sf}/supplier.parquet", ["s_suppkey", "s_name", "s_nationkey"]),
    "validate_table": lambda s, sf: src.validate_table(table(s, sf, "supplier")),
    "blank_to_null": lambda s, sf: src.blank_to_null(text(s, sf)),
    "escape_formulas": lambda s, sf: src.escape_formulas(text(s, sf)),
    "load_csv": lambda s, sf: rounded(_load_csv(s, sf)),
    "write_clean_csv": _round_trip,
    "write_clean_parquet": _round_trip_parquet,
    "write_clean_long_texts": _documents,
    "with_row_id_files": _in_files,
    "with_row_id": lambda s, sf: with_row_id(
        table(s, sf, "events").select("event_type", "ts", "event_id"), ["event_type", "ts"]
    ).select("_row_id", "event_id"),
}

_ESCAPED = "CASE WHEN regexp_matches({c}, '^[=+\\-@]') THEN '''' || {c} ELSE {c} END"

ORACLE = {
    "load_table": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "validate_table": "SELECT * FROM supplier",
    "blank_to_null": CTE_TEXT
    + """SELECT row_id, CASE WHEN trim("SegmentName") <> '' THEN "SegmentName" END AS "SegmentName", "Loyalty Points", "signup-date", note FROM fx_text""",
    "escape_formulas": CTE_TEXT
    + f"""SELECT row_id, {_ESCAPED.format(c='"SegmentName"')} AS "SegmentName", "Loyalty Points", "signup-date",
      {_ESCAPED.format(c='note')} AS note FROM fx_text""",
    "load_csv": """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 THEN c_name || ', "x"' END AS name,
      CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal, 4) END AS balance, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 = 0 END AS flag
      FROM customer WHERE c_custkey % 7 <> 0""",
    "write_clean_csv": CTE_TEXT
    + f"""SELECT row_id, CASE WHEN trim("SegmentName") <> '' THEN "SegmentName" END AS "SegmentName",
      "Loyalty Points", "signup-date", {_ESCAPED.format(c='note')} AS note FROM fx_text""",
    "write_clean_parquet": CTE_TEXT
    + f"""SELECT row_id, "SegmentName", "Loyalty Points", "signup-date", {_ESCAPED.format(c='note')} AS note FROM fx_text""",
    "write_clean_long_texts": f"""SELECT doc_id, length(t) AS length, md5(t) AS digest, lang, source, n_chars FROM (
      SELECT *, {_ESCAPED.format(c='text')} AS t FROM documents)""",
    "with_row_id_files": """SELECT row_number() OVER (ORDER BY CASE WHEN p_partkey % 100 = 7 THEN 1 WHEN p_partkey % 100 > 7 THEN 2 ELSE 3 END,
      p_partkey) - 1 AS _row_id, p_partkey, p_name FROM part""",
    "with_row_id": "SELECT row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS _row_id, event_id FROM events",
}
