"""Extreme values: methods, votes, summary, causes."""

from pyspark.sql import functions as F

from tablewright.functions import fixed_values as fv
from tablewright.operators import outliers as o
from tablewright.operators.ordering import with_row_id
from tablewright.operators.treatments import treat_by_segment

from .common import rounded, table

# metrics with errors of several kinds
FX_EXTREMES = """
SELECT {row_id} AS row_id, l_orderkey AS order_id,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 197 = 1 THEN l_extendedprice * 100 ELSE l_extendedprice END AS sales_amount,
  CASE WHEN l_orderkey % 301 = 5 THEN -l_quantity * 9 ELSE l_quantity END AS quantity,
  CASE WHEN l_orderkey % 401 = 5 THEN 200 + l_quantity ELSE l_quantity + 18 END AS age,
  CASE WHEN l_orderkey % 251 = 3 THEN 1000.0 ELSE 1.0 END AS weight,
  l_discount * 2 AS rebate, 7.0 AS constant
FROM {lineitem}
"""
COLUMNS = ["sales_amount", "quantity", "age", "weight", "rebate", "constant"]


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def extremes(spark, sf, numbered=False):
    """The fixture; `numbered` gives it contiguous row ids in a fixed order."""
    lines = table(spark, sf, "lineitem").select(*_ORDER, "l_quantity", "l_discount")
    if numbered:
        lines = with_row_id(lines, _ORDER)
    row_id = "_row_id" if numbered else "l_orderkey"
    return spark.sql(FX_EXTREMES.replace("{row_id}", row_id), lineitem=lines)


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "value")


def _features(s, sf):
    return o.outlier_features(extremes(s, sf), "row_id")


QUERIES = {
    "outliers_iqr": lambda s, sf: rounded(o.outliers_iqr(extremes(s, sf, numbered=True), "sales_amount", "row_id"), 2),
    "outliers_zscore": lambda s, sf: rounded(o.outliers_zscore(extremes(s, sf, numbered=True), "sales_amount", "row_id"), 2),
    "outliers_modified_z": lambda s, sf: rounded(o.outliers_modified_z(extremes(s, sf, numbered=True), "sales_amount", "row_id"), 2),
    "outliers_modified_z_flat": lambda s, sf: o.outliers_modified_z(extremes(s, sf, numbered=True), "weight", "row_id").withColumn("value", F.col("value").cast("double")),
    "outliers_percentile": lambda s, sf: rounded(o.outliers_percentile(_events(s, sf), "value", "event_id"), 4),
    "outlier_votes": lambda s, sf: rounded(o.outlier_votes(extremes(s, sf, numbered=True), "row_id"), 2),
    "outlier_summary": lambda s, sf: rounded(o.outlier_summary(extremes(s, sf), "row_id"), 3),
    "outlier_causes": lambda s, sf: o.outlier_causes(_features(s, sf)).select("column_name", "cause_order", "cause", "confidence"),
    "outlier_advice": lambda s, sf: o.outlier_advice(_features(s, sf)),
    "segment_outliers": lambda s, sf: rounded(o.segment_outliers(_tilted(s, sf), "status", "order_id", _TILTED), 6),
    "segment_outlier_summary": lambda s, sf: rounded(
        o.segment_outlier_summary(table(s, sf, "lineitem"), "l_suppkey", ["l_quantity", "l_extendedprice"]), 6
    ),
    "cap_by_segment": lambda s, sf: rounded(treat_by_segment(_tilted(s, sf), "price", "cap", "status"), 6),
}

_TILTED = ["price", "tax"]
#: Two thirds of the rows in one segment, some rows in none, a small segment, gaps.
_FX_TILTED = """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'most' WHEN o_orderkey % 33 = 0 THEN NULL
    WHEN o_orderkey < 15 THEN 'few' ELSE o_orderpriority END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 101 = 1 THEN o_totalprice * 50 ELSE o_totalprice END AS price,
  CAST(CASE WHEN o_orderkey % 89 = 2 THEN -9 ELSE o_orderkey % 10 END AS DOUBLE) / 100 AS tax FROM {orders}"""


def _tilted(s, sf):
    return s.sql(_FX_TILTED, orders=table(s, sf, "orders"))


_BASE = "WITH x AS (" + FX_EXTREMES.format(lineitem="lineitem", row_id=f"row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1") + "), long AS ("
_BASE += " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, row_id, CAST({c} AS DOUBLE) AS value FROM x WHERE {c} IS NOT NULL" for c in COLUMNS
)
_MOMENTS = """), s0 AS (SELECT column_name, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, median(value) AS med,
  quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.99) AS p99,
  min(value) AS low, max(value) AS high FROM long GROUP BY column_name),
s AS (SELECT s0.*, d.mad FROM s0 JOIN (SELECT column_name, median(abs(value - med)) AS mad FROM long JOIN s0 USING (column_name) GROUP BY column_name) d USING (column_name)),
v AS (SELECT column_name, row_id, value, med, n,
  value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS iqr,
  std > 0 AND abs((value - mean) / std) > 3 AS z,
  CASE WHEN mad > 0 THEN abs(0.6745 * (value - med) / mad) > 3.5 ELSE std > 0 AND abs((value - mean) / std) > 3 END AS mz,
  value < p1 OR value > p99 AS pct FROM long JOIN s USING (column_name)),
flagged AS (SELECT * FROM v WHERE iqr OR z OR mz OR pct),
f AS (SELECT column_name, count(*) AS outlier_count, max(low) < 0 AS any_negative, max(high) > 150 AS any_above_150,
  bool_or(s.med > 0 AND value / s.med >= 10) AS any_tenfold, bool_or(s.med > 0 AND round_even(value / s.med, 0) IN (100, 1000)) AS unit_factor
  FROM flagged JOIN s USING (column_name) GROUP BY column_name) """
_BASE += _MOMENTS
_EVENTS = "WITH long AS (SELECT 'value' AS column_name, event_id AS row_id, value FROM events" + _MOMENTS


def _named(words):
    return f"regexp_matches(column_name, '{'|'.join(words)}')"


_RULES = [
    (1, "Cause A: Data Entry Error", "any_tenfold OR any_negative AND " + _named(fv.NEVER_NEGATIVE_WORDS), "High"),
    (2, "Cause B: Measurement Error", "any_above_150 AND column_name LIKE '%age%'", "High"),
    (3, "Cause H: Unit Conversion Error", "unit_factor", "Medium"),
    (4, "Cause C: Genuine High/Low Value", _named(fv.GENUINE_VALUE_WORDS), "High"),
    (5, "Cause E: Fraud or Anomaly", _named(fv.FRAUD_WORDS), "Medium"),
    (6, "Cause G: Different Population Segment", "true", "Medium"),
]
_COND = {i: c for i, _, c, _ in _RULES}

ORACLE = {
    "outliers_iqr": _BASE + "SELECT row_id, round(value, 2) AS value FROM v WHERE column_name = 'sales_amount' AND iqr",
    "outliers_zscore": _BASE + "SELECT row_id, round(value, 2) AS value FROM v WHERE column_name = 'sales_amount' AND z",
    "outliers_modified_z": _BASE + "SELECT row_id, round(value, 2) AS value FROM v WHERE column_name = 'sales_amount' AND mz",
    "outliers_modified_z_flat": _BASE + "SELECT row_id, value FROM v WHERE column_name = 'weight' AND mz",
    "outliers_percentile": _EVENTS + "SELECT row_id AS event_id, round(value, 4) AS value FROM v WHERE pct",
    "outlier_votes": _BASE
    + """SELECT column_name, row_id, round(value, 2) AS value,
      concat_ws(', ', CASE WHEN iqr THEN 'IQR' END, CASE WHEN z THEN 'Z-Score' END, CASE WHEN mz THEN 'Modified Z-Score' END, CASE WHEN pct THEN 'Percentiles' END) AS methods
      FROM flagged QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY row_id) <= 15""",
    "outlier_summary": _BASE
    + """SELECT column_name, outlier_count, round(outlier_count / n * 100, 3) AS outlier_percent, round(q1 - 1.5 * (q3 - q1), 3) AS iqr_lower,
      round(q3 + 1.5 * (q3 - q1), 3) AS iqr_upper, round(CASE WHEN std > 0 THEN mean - 3 * std ELSE 0 END, 3) AS z_lower,
      round(CASE WHEN std > 0 THEN mean + 3 * std ELSE 0 END, 3) AS z_upper FROM f JOIN s USING (column_name)""",
    "outlier_causes": _BASE
    + " UNION ALL ".join(
        f"SELECT column_name, {i} AS cause_order, '{cause}' AS cause, '{sure}' AS confidence FROM f WHERE {condition}"
        for i, cause, condition, sure in _RULES
    ),
    "outlier_advice": _BASE
    + f"""SELECT column_name, outlier_count, split_part(advice, '#', 1) AS recommended_action, split_part(advice, '#', 2) AS confidence,
      split_part(advice, '#', 3) AS risk FROM (SELECT *, CASE WHEN {_COND[5]} THEN 'Flag for Investigation#Medium#High'
      WHEN {_COND[3]} THEN 'Standardize Units / Scale Column#Medium#Medium' WHEN {_COND[2]} THEN 'Remove or Correct#High#Medium'
      WHEN {_COND[1]} THEN 'Correct or Remove#High#Medium' WHEN {_COND[4]} THEN 'Keep (Do NOT Remove)#High#Low'
      ELSE 'Segment Analysis#Medium#Low' END AS advice FROM f)""",
}

_BOUNDS = """SELECT {seg} AS segment, '{c}' AS column_name, count({c}) AS n,
  quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {t} WHERE {seg} IS NOT NULL GROUP BY 1 HAVING count({c}) >= 5"""


def _bounds(t, seg, columns):
    parts = " UNION ALL ".join(_BOUNDS.format(t=t, seg=seg, c=c) for c in columns)
    return f"bounds AS (SELECT segment, column_name, n, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM ({parts}))"


def _outside(t, seg, columns, key):
    return " UNION ALL ".join(
        f"SELECT {key}, b.segment, b.column_name, {c}::DOUBLE AS value, b.lower, b.upper FROM {t} JOIN bounds b "
        f"ON b.segment = {seg} AND b.column_name = '{c}' WHERE {c} < b.lower OR {c} > b.upper"
        for c in columns
    )


_TILTED_CTE = f"WITH t AS ({_FX_TILTED.format(orders='orders')}), {_bounds('t', 'status', _TILTED)} "
_SUPPLIES = _bounds("lineitem", "l_suppkey", ["l_quantity", "l_extendedprice"])
ORACLE |= {
    "segment_outliers": _TILTED_CTE
    + f"""SELECT row_id, segment, column_name, round(value, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper
      FROM ({_outside('t', 'status', _TILTED, 'order_id AS row_id')})""",
    "segment_outlier_summary": f"WITH {_SUPPLIES}, f AS ({_outside('lineitem', 'l_suppkey', ['l_quantity', 'l_extendedprice'], '1 AS one')}) "
    """SELECT segment, column_name, n, round(lower, 6) AS lower, round(upper, 6) AS upper,
      (SELECT count(*) FROM f WHERE f.segment = b.segment AND f.column_name = b.column_name) AS outlier_count FROM bounds b""",
    "cap_by_segment": _TILTED_CTE
    + """SELECT order_id, status, round(CASE WHEN lower IS NULL OR price IS NULL THEN price ELSE least(greatest(price, lower), upper) END, 6) AS price,
      round(tax::DOUBLE, 6) AS tax FROM t LEFT JOIN bounds ON segment = status AND column_name = 'price'""",
}
