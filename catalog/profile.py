"""Profiles, scores and issues."""

from pyspark.sql import functions as F

from tablewright.operators import profile as p
from tablewright.operators import stored_profile as sp

from .common import CTE_DUPS, CTE_SALES, dups, null_cells, rounded, sales, table, union_columns

DUPS = ["order_id", "customer_id", "priority", "sales_amount"]
SALES = [
    "order_id", "customer_id", "order_date", "sales_amount", "priority", "status", "approval",
    "sensor_value", "settled_value",
]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_TYPES = {
    "order_id": "bigint", "customer_id": "bigint", "order_date": "timestamp_ntz", "sales_amount": "double",
    "priority": "string", "status": "string", "approval": "string", "sensor_value": "double",
    "settled_value": "double",
}
_NUMERIC = {"order_id", "customer_id", "sales_amount", "sensor_value", "settled_value", "c_custkey", "c_nationkey", "c_acctbal"}


def stats_sql(source: str, columns: list[str]) -> str:
    """table_stats in SQL: GROUP BY over all columns treats NULLs as equal."""
    keys = ", ".join(columns)
    return f"""
    SELECT CAST(sum(n) AS BIGINT) AS row_count, {len(columns)} AS column_count,
      CAST(sum(n * miss) AS BIGINT) AS missing_values, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
      CAST(sum(n * miss) AS DOUBLE) / (sum(n) * {len(columns)}) * 100 AS missing_percent
    FROM (SELECT count(*) AS n, max({null_cells(columns)}) AS miss FROM {source} GROUP BY {keys})"""


def profile_sql(source: str, columns: list[str]) -> str:
    """Missing, non-null and distinct counts per column in SQL."""
    return union_columns(
        columns,
        "SELECT {i} AS ordinal, '{c}' AS column_name, count(*) - count({q}) AS missing_count, "
        "count({q}) AS non_null, count(DISTINCT {q}) AS unique_count FROM " + source,
    )


def score_sql(source: str, columns: list[str]) -> str:
    numeric = ", ".join(f"'{c}'" for c in columns if c in _NUMERIC)
    return f"""
    SELECT s.*, h.n AS high_cardinality_columns, CAST(round_even(greatest(0.0, 100.0 - 2.0 * missing_percent
        - CASE WHEN duplicate_rows > 0 THEN 5.0 ELSE 0.0 END - 3.0 * h.n), 0) AS INT) AS quality_score
    FROM ({stats_sql(source, columns)}) s, (SELECT CAST(count(*) AS BIGINT) AS n FROM ({profile_sql(source, columns)})
      WHERE column_name NOT IN ({numeric}) AND unique_count > 0.9 * non_null) h"""


def _issues_sql(source, columns):
    numeric = ", ".join(f"'{c}'" for c in columns if c in _NUMERIC)
    width = len(columns)
    return f"""
    , prof AS ({profile_sql(source, columns)}), st AS ({stats_sql(source, columns)}),
    found AS (SELECT ordinal AS position, 'missing values' AS issue, column_name, missing_count AS amount FROM prof WHERE missing_count > 0
      UNION ALL SELECT {width}, 'duplicate rows', NULL, duplicate_rows FROM st WHERE duplicate_rows > 0
      UNION ALL SELECT ordinal + {width} + 1, 'high cardinality', column_name, unique_count FROM prof
        WHERE column_name NOT IN ({numeric}) AND unique_count > 0.9 * non_null)
    SELECT * FROM found UNION ALL SELECT 0, 'healthy', NULL, CAST(0 AS BIGINT) WHERE NOT EXISTS (SELECT 1 FROM found)"""


BUCKET = """CASE WHEN quality_score >= 90 THEN 'Green' WHEN quality_score >= 70 THEN 'Blue'
    WHEN quality_score >= 50 THEN 'Orange' ELSE 'Red' END AS score_bucket"""


def _stats(df, row_id=None):
    return rounded(p.table_stats(df, row_id))


QUERIES = {
    "table_stats": lambda s, sf: _stats(dups(s, sf)),
    "table_stats_lineitem": lambda s, sf: _stats(table(s, sf, "lineitem")),
    "table_stats_documents": lambda s, sf: _stats(table(s, sf, "documents")),
    "duplicate_count": lambda s, sf: p.duplicate_count(dups(s, sf)),
    "preview": lambda s, sf: p.preview(table(s, sf, "customer"), ["c_custkey"]),
    "column_profile": lambda s, sf: rounded(p.column_profile(sales(s, sf), "row_id")),
    "column_profile_lineitem": lambda s, sf: rounded(
        p.column_profile(table(s, sf, "lineitem")).select("column_name", "missing_count", "unique_count", "unique_ratio"), 6
    ),
    "numeric_stats": lambda s, sf: rounded(p.numeric_stats(sales(s, sf), "row_id"), 2),
    "quality_score": lambda s, sf: rounded(p.quality_score(sales(s, sf), "row_id")),
    "quality_score_duplicates": lambda s, sf: rounded(p.quality_score(dups(s, sf))),
    "quality_score_customer": lambda s, sf: rounded(p.quality_score(table(s, sf, "customer"))),
    "score_bucket": lambda s, sf: p.quality_score(dups(s, sf)).select("quality_score", "score_bucket"),
    # Sketches can't change these: no text column is near the limit for fragmented ones.
    "quality_score_approx": lambda s, sf: rounded(p.quality_score(sales(s, sf), "row_id", approx=True)),
    "issues_approx": lambda s, sf: p.issues(sales(s, sf), "row_id", approx=True),
    "issues": lambda s, sf: p.issues(sales(s, sf), "row_id"),
    "issues_duplicates": lambda s, sf: p.issues(dups(s, sf)),
    "issues_healthy": lambda s, sf: p.issues(table(s, sf, "orders")),
    "completeness_score": lambda s, sf: p.completeness_score(sales(s, sf), "row_id"),
    "missing_by_column": lambda s, sf: rounded(p.missing_by_column(sales(s, sf), "row_id")),
    "merged_profile": lambda s, sf: _merged_profile(s, sf, []),
    "merged_profile_by_status": lambda s, sf: _merged_profile(s, sf, ["o_orderstatus"]),
    "duplicate_sample": lambda s, sf: p.duplicate_sample(_numbered_dups(s, sf), "copy_id"),
}


def _numbered_dups(s, sf):
    """Copies of orders with an id of their own, so that "the first rows" is defined."""
    return s.sql(
        """SELECT order_id * 2 AS copy_id, order_id, priority, sales_amount FROM {x}
           UNION ALL SELECT order_id * 2 + 1, order_id, priority, sales_amount FROM {x} WHERE order_id % 50 = 3""",
        x=sales(s, sf),
    )


def _merged_profile(s, sf, by):
    """Parts by month and status, merged to coarser ones. Distinct counts up to 100 are
    exact in a sketch that small; larger ones are estimates and only tested (tests/test_stored_profile)."""
    orders = table(s, sf, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    parts = sp.profile_parts(orders, ["month", "o_orderstatus"])
    facts = sp.stored_column_profile(sp.merge_parts(parts, by))
    few = F.when(F.col("unique_count") <= 100, F.col("unique_count"))
    return rounded(facts.select(*by, "column_name", "missing_count", few.alias("few_values"), "min_value", "max_value", "mean_value"))


def _merged_sql(by):
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    numeric = ["o_orderkey", "o_custkey", "o_totalprice"]
    return " UNION ALL ".join(
        f"SELECT {keys}'{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        f"CASE WHEN count(DISTINCT {c}) <= 100 THEN count(DISTINCT {c}) END AS few_values, "
        + ", ".join(
            (f"round({f}(CAST({c} AS DOUBLE)), 4)" if c in numeric else "CAST(NULL AS DOUBLE)") + f" AS {label}"
            for f, label in (("min", "min_value"), ("max", "max_value"), ("avg", "mean_value"))
        )
        + f" FROM orders{group}"
        for c in [*numeric, "o_orderdate", "o_orderpriority"]
    )


def _scored(source, columns):
    return (
        f"SELECT row_count, column_count, missing_values, duplicate_rows, round(missing_percent, 4) AS missing_percent, "
        f"high_cardinality_columns, quality_score, {BUCKET} FROM ({score_sql(source, columns)})"
    )


def _stats_rounded(source, columns):
    return f"SELECT * REPLACE (round(missing_percent, 4) AS missing_percent) FROM ({stats_sql(source, columns)})"


ORACLE = {
    "table_stats": CTE_DUPS + _stats_rounded("fx_dups", DUPS),
    "table_stats_lineitem": _stats_rounded("lineitem", LINEITEM),
    "table_stats_documents": _stats_rounded("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
    "duplicate_count": CTE_DUPS + f"SELECT duplicate_rows FROM ({stats_sql('fx_dups', DUPS)})",
    "preview": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
      CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 10""",
    "column_profile": CTE_SALES
    + "SELECT ordinal, column_name, data_type, missing_count, unique_count, round(unique_count / non_null, 4) AS unique_ratio, "
    "is_numeric, round(lo, 4) AS min_value, round(hi, 4) AS max_value, round(mean, 4) AS mean_value FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, '{_TYPES[c]}' AS data_type, count(*) - count({c}) AS missing_count, "
        f"count(DISTINCT {c}) AS unique_count, CAST(count({c}) AS DOUBLE) AS non_null, {c in _NUMERIC} AS is_numeric, "
        + (
            f"CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, avg(CAST({c} AS DOUBLE)) AS mean FROM fx_sales"
            if c in _NUMERIC
            else "CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS mean FROM fx_sales"
        )
        for i, c in enumerate(SALES)
    )
    + ")",
    "column_profile_lineitem": "SELECT column_name, missing_count, unique_count, round(CAST(unique_count AS DOUBLE) / non_null, 6) AS unique_ratio FROM ("
    + profile_sql("lineitem", LINEITEM)
    + ")",
    "numeric_stats": CTE_SALES
    + union_columns(
        [c for c in SALES if c in _NUMERIC],
        "SELECT '{c}' AS column_name, round(CAST(min({q}) AS DOUBLE), 2) AS min_value, round(CAST(max({q}) AS DOUBLE), 2) AS max_value, "
        "round(avg(CAST({q} AS DOUBLE)), 2) AS mean_value FROM fx_sales",
    ),
    "quality_score": CTE_SALES + _scored("fx_sales", SALES),
    "quality_score_duplicates": CTE_DUPS + _scored("fx_dups", DUPS),
    "quality_score_customer": _scored("customer", CUSTOMER),
    "score_bucket": CTE_DUPS + f"SELECT quality_score, {BUCKET} FROM ({score_sql('fx_dups', DUPS)})",
    "issues": CTE_SALES + _issues_sql("fx_sales", SALES),
    "issues_duplicates": CTE_DUPS + _issues_sql("fx_dups", DUPS),
    "issues_healthy": "WITH one AS (SELECT 1)"
    + _issues_sql(
        "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    ).replace("NOT IN ()", "NOT IN ('o_orderkey', 'o_custkey', 'o_totalprice')"),
    "completeness_score": CTE_SALES
    + f"SELECT CAST(round_even((1 - sum({null_cells(SALES)}) / (count(*) * {len(SALES)}.0)) * 100, 2) AS DOUBLE) AS completeness_score FROM fx_sales",
    "missing_by_column": CTE_SALES
    + "SELECT ordinal, column_name, missing_count, round(missing_count / (missing_count + non_null) * 100, 4) AS missing_percent FROM ("
    + profile_sql("fx_sales", SALES)
    + ") WHERE missing_count > 0",
    "merged_profile": _merged_sql([]),
    "merged_profile_by_status": _merged_sql(["o_orderstatus"]),
    "duplicate_sample": CTE_SALES
    + """, copies AS (SELECT order_id * 2 AS copy_id, order_id, priority, sales_amount FROM fx_sales
        UNION ALL SELECT order_id * 2 + 1, order_id, priority, sales_amount FROM fx_sales WHERE order_id % 50 = 3)
      SELECT copy_id, order_id, priority, sales_amount FROM (SELECT *, count(*) OVER (PARTITION BY order_id, priority, sales_amount) AS n FROM copies)
      WHERE n > 1 ORDER BY copy_id LIMIT 10""",
}
ORACLE |= {"quality_score_approx": ORACLE["quality_score"], "issues_approx": ORACLE["issues"]}
