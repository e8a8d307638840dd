"""Inputs of the checked queries and helpers shared by the modules.

The dirty projections are written once, in SQL that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import col
from tablewright.sources import load_table

FX_SALES = """
SELECT o_orderkey AS row_id, o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 1 THEN o_totalprice * 100 ELSE o_totalprice END AS sales_amount,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  o_orderstatus AS status,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN NULL ELSE concat(o_orderstatus, '-ok') END AS approval,
  CASE WHEN o_orderkey BETWEEN 100 AND 119 THEN NULL ELSE o_totalprice / 10 END AS sensor_value,
  CASE WHEN o_orderkey > (SELECT max(o_orderkey) - 20 FROM {orders}) THEN NULL ELSE o_totalprice * 2 END AS settled_value
FROM {orders}
"""

FX_DUPS = """
SELECT order_id, customer_id, priority, sales_amount FROM {fx_sales}
UNION ALL SELECT order_id, customer_id, priority, sales_amount FROM {fx_sales} WHERE order_id % 50 = 0
UNION ALL SELECT NULL, NULL, NULL, NULL FROM {region}
"""

# customer texts; labels are quoted with backticks for Spark
FX_TEXT = """
SELECT c_custkey AS row_id,
  CASE WHEN c_custkey % 9 = 0 THEN '   ' WHEN c_custkey % 4 = 0 THEN concat('  ', c_mktsegment, '   x ') ELSE c_mktsegment END AS `SegmentName`,
  CASE WHEN c_custkey % 40 = 0 THEN 'unknown' ELSE concat('', c_custkey) END AS `Loyalty Points`,
  CASE WHEN c_custkey % 30 = 0 AND c_custkey > 0 THEN 'not a day' ELSE concat('2024-01-', CASE WHEN c_custkey % 28 < 9 THEN '0' ELSE '' END, c_custkey % 28 + 1) END AS `signup-date`,
  CASE WHEN c_custkey % 6 = 0 THEN concat('=', c_name) ELSE c_name END AS note
FROM {customer}
"""

# a sales fact: metrics, a date, categories and a place
FX_FACTS = """
SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, l.l_shipdate AS ship_date, l.l_extendedprice AS sales_amount,
  l.l_quantity AS quantity, l.l_discount AS discount, l.l_returnflag AS return_flag, l.l_linestatus AS line_status,
  s.s_name AS supplier_name, n.n_name AS region_nation
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf}/{name}.parquet")


def sales(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(FX_SALES, orders=table(spark, sf, "orders"))


def dups(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(FX_DUPS, fx_sales=sales(spark, sf), region=table(spark, sf, "region"))


def text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(FX_TEXT, customer=table(spark, sf, "customer"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(FX_FACTS, **{t: table(spark, sf, t) for t in ("lineitem", "supplier", "nation")})


_SALES_SQL = FX_SALES.format(orders="orders")
_TEXT_SQL = FX_TEXT.format(customer="customer").replace("`", '"')
CTE_SALES = f"WITH fx_sales AS ({_SALES_SQL})"
CTE_DUPS = CTE_SALES + f", fx_dups AS ({FX_DUPS.format(fx_sales='fx_sales', region='region')})"
CTE_TEXT = f"WITH fx_text AS ({_TEXT_SQL})"
CTE_FACTS = "WITH fx_facts AS (" + FX_FACTS.format(
    lineitem="lineitem", supplier="supplier", nation="nation"
) + ")"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles, so that the order of additions does not show."""
    return df.select(
        *[
            F.round(col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)
            for f in df.schema.fields
        ]
    )


def null_cells(columns: list[str]) -> str:
    """SQL for the number of missing cells in a row."""
    return " + ".join(f'("{c}" IS NULL)::INT' for c in columns)


def union_columns(columns: list[str], template: str) -> str:
    """One SELECT per column, `{i}`, `{c}` and `{q}` replaced by place, name and quoted name."""
    return " UNION ALL ".join(
        template.replace("{i}", str(i)).replace("{c}", c).replace("{q}", f'"{c}"') for i, c in enumerate(columns)
    )
