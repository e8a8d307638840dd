"""Cleaning steps, the automatic run, approved treatments."""

from pyspark.sql import functions as F

from tablewright.operators import cleaning as c
from tablewright.operators import treatments as t
from tablewright.plans.approved import apply_cleaning, cleaning_comparison
from tablewright.plans.automatic import clean_table, cleaning_advice
from tablewright.functions.storage import scratch_path
from tablewright.sources import blank_to_null, write_audit

from .common import CTE_DUPS, CTE_SALES, CTE_TEXT, dups, rounded, sales, table, text
from .profile import SALES, score_sql

_ORDERED = """SELECT row_id, status, CASE WHEN order_id % 7 < 3 OR order_id < 2 THEN NULL ELSE order_date END AS order_date,
  CASE WHEN order_id % 5 < 2 THEN NULL ELSE priority END AS priority FROM {fx_sales}"""


def _ordered(s, sf):
    return s.sql(_ORDERED, fx_sales=sales(s, sf))


_MIXED = """SELECT c_custkey AS row_id, CASE c_custkey % 5 WHEN 0 THEN '2024-03-09' WHEN 1 THEN '03/09/2024' WHEN 2 THEN '9 Mar 2024'
  WHEN 3 THEN '20240309' ELSE concat('day ', c_custkey) END AS start_date FROM {customer}"""


def _mixed(s, sf):
    return s.sql(_MIXED, customer=table(s, sf, "customer"))


def _loaded_text(s, sf):
    return blank_to_null(text(s, sf))


def _gappy(s, sf):
    """Sales with gaps in the date, too."""
    return sales(s, sf).withColumn("order_date", F.expr("CASE WHEN order_id % 17 = 0 THEN NULL ELSE order_date END"))


CONFIG = {
    "remove_duplicates": True,
    "remove_empty_rows": True,
    "missing_actions": {"sales_amount": "median", "priority": "na_string", "customer_id": "skip"},
    "outlier_actions": {"sales_amount": "remove"},
}
TREATMENTS = {
    "missing_actions": {
        "sales_amount": "indicator", "priority": "mode", "approval": "keep_null", "sensor_value": "mean",
        "settled_value": "ffill",
    },
    "outlier_actions": {"sales_amount": "cap", "sensor_value": "nullify", "settled_value": "keep"},
}


def _write_audit(s, sf):
    path = scratch_path(s, "audit")
    write_audit(apply_cleaning(dups(s, sf), CONFIG).audit, path, "dups", 90, "json")
    return s.read.json(path).select("step", "action", "status", "rows_affected", "dataset_id", "initial_score")


def _write_audit_text(s, sf):
    path = scratch_path(s, "audit")
    write_audit(apply_cleaning(dups(s, sf), CONFIG).audit, path, "dups", 90)
    return s.read.text(path)


def _comparison(s, sf):
    before = dups(s, sf)
    return cleaning_comparison(before, apply_cleaning(before, CONFIG).table)


def _metrics(result):
    return result.metrics


# orders with a second copy of some, each row with an id of its own
_COPIES = """SELECT o_orderkey * 2 + 1 AS _row_id, * FROM {orders} WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey * 2 AS _row_id, * FROM {orders}"""

#: Weights in kilograms, grams and milligrams, extreme values that no unit explains, gaps, and a
#: column with the name that a flag would take.
FX_MISTAKEN = """SELECT row_id, sales_amount, 1 AS heavy_outlier,
  CASE WHEN row_id % 7 = 0 THEN NULL WHEN row_id % 53 = 1 THEN (40 + customer_id % 20) * 1000.0 WHEN row_id % 59 = 2 THEN (40 + customer_id % 20) * 100.0
  WHEN row_id % 61 = 3 THEN -5000.0 WHEN row_id % 67 = 4 THEN 900.0 ELSE 40.0 + customer_id % 20 END AS heavy FROM {fx_sales}"""
UNITS = {"outlier_actions": {"sales_amount": "flag", "heavy": "rescale"}}


def _mistaken(s, sf):
    return s.sql(FX_MISTAKEN, fx_sales=sales(s, sf))


QUERIES = {
    "drop_empty_rows": lambda s, sf: c.drop_empty_rows(dups(s, sf)),
    "drop_duplicates_first": lambda s, sf: c.drop_duplicates_first(dups(s, sf)),
    "drop_duplicates_first_by_row": lambda s, sf: c.drop_duplicates_first(
        s.sql(_COPIES, orders=table(s, sf, "orders")), "_row_id"
    ),
    "snake_case_columns": lambda s, sf: c.snake_case_columns(text(s, sf)),
    "trim_text": lambda s, sf: c.trim_text(text(s, sf)),
    "parse_dates": lambda s, sf: c.parse_dates(text(s, sf), "row_id").select(
        "row_id", F.col("signup-date").cast("string").alias("signup_date")
    ),
    "parse_dates_mixed": lambda s, sf: c.parse_dates(
        _mixed(s, sf), "row_id", formats=["yyyy-MM-dd", "MM/dd/yyyy", "d MMM yyyy", "yyyyMMdd"]
    ).select("row_id", F.col("start_date").cast("string").alias("start_date")),
    "coerce_numeric": lambda s, sf: c.coerce_numeric(text(s, sf)),
    "fill_median": lambda s, sf: rounded(c.fill_median(sales(s, sf), ["sales_amount", "sensor_value", "customer_id"])).select(
        "row_id", "sales_amount", "sensor_value", "customer_id"
    ),
    "fill_mode": lambda s, sf: c.fill_mode(sales(s, sf)).select("row_id", "priority", "status", "approval"),
    "fill_forward": lambda s, sf: c.fill_forward(_ordered(s, sf), ["order_date", "priority"], "row_id", block_rows=997).select(
        "row_id", "status", F.col("order_date").cast("string").alias("order_date"), "priority"
    ),
    "clean_table": lambda s, sf: clean_table(_loaded_text(s, sf), "row_id").table.withColumn(
        "signup_date", F.col("signup_date").cast("string")
    ),
    "clean_table_metrics": lambda s, sf: _metrics(clean_table(_loaded_text(s, sf), "row_id")),
    "clean_table_log": lambda s, sf: clean_table(_loaded_text(s, sf), "row_id").log.select(
        "step", "column_name", "action", "status", "rows_affected", "value"
    ),
    "clean_table_sales": lambda s, sf: rounded(clean_table(_gappy(s, sf), "row_id").table).withColumn(
        "order_date", F.col("order_date").cast("string")
    ),
    "clean_table_duplicates": lambda s, sf: _metrics(clean_table(dups(s, sf))),
    "cleaning_advice": lambda s, sf: cleaning_advice(text(s, sf), "row_id"),
    "cleaning_advice_duplicates": lambda s, sf: cleaning_advice(dups(s, sf)),
    "cleaning_advice_clean": lambda s, sf: cleaning_advice(table(s, sf, "orders")),
    "apply_cleaning": lambda s, sf: rounded(apply_cleaning(dups(s, sf), CONFIG).table),
    "apply_cleaning_treatments": lambda s, sf: rounded(apply_cleaning(sales(s, sf), TREATMENTS, "row_id").table, 4).drop(
        "order_date"
    ),
    "audit_log": lambda s, sf: apply_cleaning(dups(s, sf), CONFIG).audit.select(
        "step", "column_name", "action", "status", "rows_affected"
    ),
    "write_audit": _write_audit,
    "write_audit_text": _write_audit_text,
    "cleaning_comparison": _comparison,
    "impute_mean": lambda s, sf: rounded(t.impute(sales(s, sf), "sales_amount", "mean").select("row_id", "sales_amount")),
    "impute_mode": lambda s, sf: t.impute(sales(s, sf), "approval", "mode").select("row_id", "approval"),
    "impute_forward": lambda s, sf: t.impute(sales(s, sf), "priority", "ffill", "row_id").select("row_id", "priority"),
    "impute_na_string": lambda s, sf: t.impute(sales(s, sf), "priority", "na_string").select("row_id", "priority"),
    "impute_indicator": lambda s, sf: rounded(
        t.impute(sales(s, sf), "sales_amount", "indicator").select("row_id", "sales_amount", "sales_amount_missing")
    ),
    "treat_outliers_remove": lambda s, sf: rounded(t.treat_outliers(sales(s, sf), "sales_amount", "remove").select("row_id", "sales_amount")),
    "treat_outliers_cap": lambda s, sf: rounded(t.treat_outliers(sales(s, sf), "sales_amount", "cap").select("row_id", "sales_amount")),
    "treat_outliers_rescale": lambda s, sf: rounded(t.treat_outliers(sales(s, sf), "sales_amount", "rescale").select("row_id", "sales_amount")),
    "treat_outliers_flag": lambda s, sf: rounded(
        t.treat_outliers(sales(s, sf), "sales_amount", "flag").select("row_id", "sales_amount", "sales_amount_outlier")
    ),
    "apply_cleaning_units": lambda s, sf: rounded(
        apply_cleaning(_mistaken(s, sf), UNITS).table.select("row_id", "sales_amount", "sales_amount_outlier", "heavy", "heavy_outlier"), 6
    ),
    "apply_cleaning_units_log": lambda s, sf: apply_cleaning(_mistaken(s, sf), UNITS).audit.select(
        "column_name", "action", "status", "rows_affected", "message"
    ),
    "treat_outliers_nullify": lambda s, sf: rounded(t.treat_outliers(sales(s, sf), "sales_amount", "nullify").select("row_id", "sales_amount")),
}


def _mode(source, column):
    return f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _median(source, column):
    return f"(SELECT quantile_cont(CAST({column} AS DOUBLE), 0.5) FROM {source})"


def _forward(column):
    """Last value before, else the first value at all."""
    return (
        f"coalesce(last_value({column} IGNORE NULLS) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING), "
        f"first_value({column} IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    )


_SQUEEZED = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_DAY = "CASE WHEN \"signup-date\" <> 'not a day' THEN \"signup-date\" || ' 00:00:00' END"
_POINTS = "try_cast(\"Loyalty Points\" AS DOUBLE)"
_LOADED = CTE_TEXT + """, loaded AS (SELECT row_id, CASE WHEN trim("SegmentName") <> '' THEN "SegmentName" END AS "SegmentName",
  "Loyalty Points", "signup-date", note FROM fx_text)"""
_CLEAN_TEXT = _LOADED + f""", trimmed AS (SELECT row_id, {_SQUEEZED.format(c='"SegmentName"')} AS segment_name,
  {_POINTS} AS loyalty_points, {_DAY} AS signup_date, {_SQUEEZED.format(c='note')} AS note FROM loaded),
  cleaned AS (SELECT row_id, coalesce(segment_name, {_mode('trimmed', 'segment_name')}) AS segment_name, loyalty_points, signup_date, note FROM trimmed)"""
_TEXT_LABELS = ['SegmentName', 'Loyalty Points', 'signup-date', 'note']


def _score(source, columns, numeric=()):
    """quality_score of a source; `numeric` are columns the score does not punish."""
    sql = score_sql(source, [f"{c}" for c in columns])
    plain = ", ".join(f"'{c}'" for c in numeric) or "''"
    head, _, rest = sql.partition("WHERE column_name NOT IN (")
    return "(SELECT quality_score FROM (" + head + "WHERE column_name NOT IN (" + plain + rest[rest.index(")"):] + "))"


_BOUNDS = """, b AS (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
  quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t})"""

_APPROVED = CTE_DUPS + f""", d1 AS (SELECT DISTINCT * FROM fx_dups),
  d2 AS (SELECT * FROM d1 WHERE NOT (order_id IS NULL AND customer_id IS NULL AND priority IS NULL AND sales_amount IS NULL)),
  d3 AS (SELECT order_id, customer_id, coalesce(priority, 'N/A') AS priority, coalesce(sales_amount, {_median('d2', 'sales_amount')}) AS sales_amount FROM d2)
  {_BOUNDS.format(c='sales_amount', t='d3')},
  d4 AS (SELECT d3.* FROM d3, b WHERE NOT coalesce(sales_amount < lo OR sales_amount > hi, false))"""

_STEPS = _APPROVED + """, steps AS (
  SELECT 0 AS step, CAST(NULL AS VARCHAR) AS column_name, 'drop_duplicates' AS action, (SELECT count(*) FROM fx_dups) - (SELECT count(*) FROM d1) AS n
  UNION ALL SELECT 1, NULL, 'drop_empty_rows', (SELECT count(*) FROM d1) - (SELECT count(*) FROM d2)
  UNION ALL SELECT 2, 'sales_amount', 'median', (SELECT count(*) - count(sales_amount) FROM d2)
  UNION ALL SELECT 3, 'priority', 'na_string', (SELECT count(*) - count(priority) FROM d2)
  UNION ALL SELECT 4, 'sales_amount', 'remove', (SELECT count(*) FROM d3) - (SELECT count(*) FROM d4))"""

_TREATED = CTE_SALES + f""", i AS (SELECT row_id, order_id, customer_id,
    coalesce(sales_amount, {_median('fx_sales', 'sales_amount')}) AS sales_amount,
    coalesce(priority, {_mode('fx_sales', 'priority')}) AS priority, status, approval,
    coalesce(sensor_value, (SELECT avg(sensor_value) FROM fx_sales)) AS sensor_value,
    {_forward('settled_value')} AS settled_value, CAST(sales_amount IS NULL AS INT) AS sales_amount_missing FROM fx_sales)
  {_BOUNDS.format(c='sales_amount', t='i')}{_BOUNDS.format(c='sensor_value', t='i').replace(', b AS', ', v AS')}
  SELECT row_id, order_id, customer_id, round(least(greatest(sales_amount, b.lo), b.hi), 4) AS sales_amount, priority, status, approval,
    CASE WHEN sensor_value >= v.lo AND sensor_value <= v.hi THEN round(sensor_value, 4) END AS sensor_value,
    round(settled_value, 4) AS settled_value, sales_amount_missing FROM i, b, v"""

_SALES_BOUNDS = CTE_SALES + _BOUNDS.format(c="sales_amount", t="fx_sales")

#: The unit a value outside the bounds is too large by, if dividing brings it inside; else 1.
_UNIT = """CASE WHEN {c} < lo OR {c} > hi THEN CASE WHEN ({c} / mid) ^ 2 >= 1000 AND ({c} / mid) ^ 2 < 100000 AND {c} / 100 >= lo AND {c} / 100 <= hi THEN 100.0
  WHEN ({c} / mid) ^ 2 >= 100000 AND ({c} / mid) ^ 2 < 10000000 AND {c} / 1000 >= lo AND {c} / 1000 <= hi THEN 1000.0 ELSE 1.0 END ELSE 1.0 END"""
_MISTAKEN = CTE_SALES + ", f AS (" + FX_MISTAKEN.format(fx_sales="fx_sales") + ")" + "".join(
    f""", {a} AS (SELECT mid, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1,
      quantile_cont({c}::DOUBLE, 0.5) AS mid, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM f))"""
    for a, c in (("s", "sales_amount"), ("h", "heavy"))
) + " "

ORACLE = {
    "drop_empty_rows": CTE_DUPS + """SELECT * FROM fx_dups WHERE order_id IS NOT NULL OR customer_id IS NOT NULL
      OR priority IS NOT NULL OR sales_amount IS NOT NULL""",
    "drop_duplicates_first": CTE_DUPS + "SELECT DISTINCT * FROM fx_dups",
    "drop_duplicates_first_by_row": f"""SELECT min(_row_id) AS _row_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
      FROM ({_COPIES.format(orders='orders')}) GROUP BY ALL""",
    "snake_case_columns": CTE_TEXT
    + 'SELECT row_id, "SegmentName" AS segment_name, "Loyalty Points" AS loyalty_points, "signup-date" AS signup_date, note FROM fx_text',
    "trim_text": CTE_TEXT
    + f"""SELECT row_id, {_SQUEEZED.format(c='"SegmentName"')} AS "SegmentName", {_SQUEEZED.format(c='"Loyalty Points"')} AS "Loyalty Points",
      "signup-date", {_SQUEEZED.format(c='note')} AS note FROM fx_text""",
    "parse_dates": CTE_TEXT + f"SELECT row_id, {_DAY} AS signup_date FROM fx_text",
    "parse_dates_mixed": "SELECT c_custkey AS row_id, CASE WHEN c_custkey % 5 < 4 THEN '2024-03-09 00:00:00' END AS start_date FROM customer",
    "coerce_numeric": CTE_TEXT
    + f'SELECT row_id, "SegmentName", {_POINTS} AS "Loyalty Points", "signup-date", note FROM fx_text',
    "fill_median": CTE_SALES
    + f"""SELECT row_id, round(coalesce(sales_amount, {_median('fx_sales', 'sales_amount')}), 4) AS sales_amount,
      round(coalesce(sensor_value, {_median('fx_sales', 'sensor_value')}), 4) AS sensor_value, CAST(customer_id AS DOUBLE) AS customer_id FROM fx_sales""",
    "fill_mode": CTE_SALES
    + f"""SELECT row_id, coalesce(priority, {_mode('fx_sales', 'priority')}) AS priority, status,
      coalesce(approval, {_mode('fx_sales', 'approval')}) AS approval FROM fx_sales""",
    "fill_forward": CTE_SALES
    + f""", o AS ({_ORDERED.format(fx_sales='fx_sales')}) SELECT row_id, status, strftime({_forward('order_date')}, '%Y-%m-%d %H:%M:%S') AS order_date,
      {_forward('priority')} AS priority FROM o""",
    "clean_table": _CLEAN_TEXT + "SELECT * FROM cleaned",
    "clean_table_metrics": _CLEAN_TEXT
    + f"""SELECT count(*) AS rows_before, count(*) AS rows_after, sum(("SegmentName" IS NULL)::INT)::BIGINT AS missing_filled,
      CAST(0 AS BIGINT) AS duplicates_removed, CAST(0 AS BIGINT) AS empty_rows_removed, 3 AS columns_renamed, 2 AS datatypes_fixed,
      {_score('loaded', ['SegmentName', 'Loyalty Points', 'signup-date', 'note']).replace('GROUP BY SegmentName, Loyalty Points, signup-date, note', 'GROUP BY "SegmentName", "Loyalty Points", "signup-date", note')} AS quality_before,
      {_score('cleaned', ['segment_name', 'loyalty_points', 'signup_date', 'note'], ['loyalty_points'])} AS quality_after FROM loaded""",
    "clean_table_log": _CLEAN_TEXT
    + f"""SELECT 0 AS step, CAST(NULL AS VARCHAR) AS column_name, 'rename_columns' AS action, 'APPROVED' AS status, CAST(3 AS BIGINT) AS rows_affected, CAST(NULL AS VARCHAR) AS value
      UNION ALL SELECT 1, 'signup_date', 'parse_dates', 'APPROVED', 0, NULL
      UNION ALL SELECT 2, 'loyalty_points', 'coerce_numeric', 'APPROVED', 0, NULL
      UNION ALL SELECT 3, 'segment_name', 'fill_mode', 'APPROVED', (SELECT count(*) - count("SegmentName") FROM loaded), {_mode('trimmed', 'segment_name')}""",
    "clean_table_sales": CTE_SALES
    + f""", g AS (SELECT * REPLACE (CASE WHEN order_id % 17 = 0 THEN NULL ELSE order_date END AS order_date) FROM fx_sales)
      SELECT row_id, order_id, customer_id, strftime({_forward('order_date')}, '%Y-%m-%d %H:%M:%S') AS order_date,
      round(coalesce(sales_amount, {_median('g', 'sales_amount')}), 4) AS sales_amount, coalesce(priority, {_mode('g', 'priority')}) AS priority,
      status, coalesce(approval, {_mode('g', 'approval')}) AS approval, round(coalesce(sensor_value, {_median('g', 'sensor_value')}), 4) AS sensor_value,
      round(coalesce(settled_value, {_median('g', 'settled_value')}), 4) AS settled_value FROM g""",
    "clean_table_duplicates": CTE_DUPS
    + f""", e AS (SELECT * FROM fx_dups WHERE order_id IS NOT NULL), u AS (SELECT DISTINCT * FROM e),
      f AS (SELECT order_id, customer_id, coalesce(priority, {_mode('u', 'priority')}) AS priority, coalesce(sales_amount, {_median('u', 'sales_amount')}) AS sales_amount FROM u)
      SELECT (SELECT count(*) FROM fx_dups) AS rows_before, (SELECT count(*) FROM u) AS rows_after,
      (SELECT sum((priority IS NULL)::INT + (sales_amount IS NULL)::INT)::BIGINT FROM u) AS missing_filled,
      (SELECT count(*) FROM e) - (SELECT count(*) FROM u) AS duplicates_removed, (SELECT count(*) FROM fx_dups) - (SELECT count(*) FROM e) AS empty_rows_removed,
      0 AS columns_renamed, 0 AS datatypes_fixed, {_score('fx_dups', ['order_id', 'customer_id', 'priority', 'sales_amount'], ['order_id', 'customer_id', 'sales_amount'])} AS quality_before,
      {_score('f', ['order_id', 'customer_id', 'priority', 'sales_amount'], ['order_id', 'customer_id', 'sales_amount'])} AS quality_after""",
    "cleaning_advice": CTE_TEXT
    + """SELECT 2 AS position, 'rename columns' AS advice, CAST(NULL AS VARCHAR) AS column_name, CAST(3 AS BIGINT) AS amount
      UNION ALL SELECT 5, 'trim text', 'SegmentName', count(*) FROM fx_text WHERE "SegmentName" LIKE ' %' OR "SegmentName" LIKE '% ' OR "SegmentName" LIKE '%  %'
      UNION ALL SELECT 10, 'convert to number', 'Loyalty Points', count(*) FROM fx_text WHERE "Loyalty Points" <> 'unknown'
      UNION ALL SELECT 12, 'parse dates', 'signup-date', 1""",
    "cleaning_advice_duplicates": CTE_DUPS
    + """SELECT 0 AS position, 'remove duplicates' AS advice, CAST(NULL AS VARCHAR) AS column_name, (SELECT count(*) FROM fx_dups) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_dups)) AS amount
      UNION ALL SELECT 1, 'remove empty rows', NULL, count(*) FROM fx_dups WHERE order_id IS NULL AND customer_id IS NULL AND priority IS NULL AND sales_amount IS NULL
      UNION ALL SELECT 3, 'fill with median', 'order_id', count(*) - count(order_id) FROM fx_dups
      UNION ALL SELECT 7, 'fill with median', 'customer_id', count(*) - count(customer_id) FROM fx_dups
      UNION ALL SELECT 11, 'fill with mode', 'priority', count(*) - count(priority) FROM fx_dups
      UNION ALL SELECT 15, 'fill with median', 'sales_amount', count(*) - count(sales_amount) FROM fx_dups""",
    "cleaning_advice_clean": "SELECT 0 AS position, 'nothing to clean' AS advice, CAST(NULL AS VARCHAR) AS column_name, count(*) - count(o_orderkey) AS amount FROM orders",
    "apply_cleaning": _APPROVED + "SELECT order_id, customer_id, priority, round(sales_amount, 4) AS sales_amount FROM d4",
    "apply_cleaning_treatments": _TREATED,
    "audit_log": _STEPS + "SELECT step, column_name, action, 'APPROVED' AS status, n AS rows_affected FROM steps",
    "write_audit": _STEPS
    + "SELECT CAST(step AS BIGINT) AS step, action, 'APPROVED' AS status, n AS rows_affected, 'dups' AS dataset_id, CAST(90 AS BIGINT) AS initial_score FROM steps",
    "write_audit_text": _STEPS
    + """SELECT '- [APPROVED] ' || CASE step WHEN 0 THEN 'Removed ' || n || ' duplicate rows.' WHEN 1 THEN 'Removed ' || n || ' empty rows.'
      WHEN 4 THEN n || ' outliers of ''sales_amount'': remove.'
      ELSE format('Filled {} missing values of ''{}'' ({}).', n, column_name, action) END AS value FROM steps
      UNION ALL SELECT unnest(['=== Data Cleaning Audit Log ===', 'File ID: dups', 'Initial Quality Score: 90/100', 'Applied Changes:'])""",
    "cleaning_comparison": _APPROVED
    + f"""SELECT (SELECT count(*) FROM fx_dups) AS rows_before, (SELECT count(*) FROM d4) AS rows_after,
      {_score('fx_dups', ['order_id', 'customer_id', 'priority', 'sales_amount'], ['order_id', 'customer_id', 'sales_amount'])} AS score_before,
      {_score('d4', ['order_id', 'customer_id', 'priority', 'sales_amount'], ['order_id', 'customer_id', 'sales_amount'])} AS score_after""",
    "impute_mean": CTE_SALES + "SELECT row_id, round(coalesce(sales_amount, (SELECT avg(sales_amount) FROM fx_sales)), 4) AS sales_amount FROM fx_sales",
    "impute_mode": CTE_SALES + f"SELECT row_id, coalesce(approval, {_mode('fx_sales', 'approval')}) AS approval FROM fx_sales",
    "impute_forward": CTE_SALES + f"SELECT row_id, {_forward('priority')} AS priority FROM fx_sales",
    "impute_na_string": CTE_SALES + "SELECT row_id, coalesce(priority, 'N/A') AS priority FROM fx_sales",
    "impute_indicator": CTE_SALES
    + f"""SELECT row_id, round(coalesce(sales_amount, {_median('fx_sales', 'sales_amount')}), 4) AS sales_amount,
      CAST(sales_amount IS NULL AS INT) AS sales_amount_missing FROM fx_sales""",
    "treat_outliers_remove": _SALES_BOUNDS
    + "SELECT row_id, round(sales_amount, 4) AS sales_amount FROM fx_sales, b WHERE NOT coalesce(sales_amount < lo OR sales_amount > hi, false)",
    "treat_outliers_cap": _SALES_BOUNDS
    + "SELECT row_id, CASE WHEN sales_amount IS NOT NULL THEN round(least(greatest(sales_amount, lo), hi), 4) END AS sales_amount FROM fx_sales, b",
    "treat_outliers_rescale": _SALES_BOUNDS
    + f", m AS (SELECT quantile_cont(sales_amount::DOUBLE, 0.5) AS mid FROM fx_sales) SELECT row_id, round(sales_amount / {_UNIT.format(c='sales_amount')}, 4) AS sales_amount FROM fx_sales, b, m",
    "treat_outliers_flag": _SALES_BOUNDS
    + "SELECT row_id, round(sales_amount, 4) AS sales_amount, CAST(coalesce(sales_amount < lo OR sales_amount > hi, false) AS INT) AS sales_amount_outlier FROM fx_sales, b",
    "apply_cleaning_units": _MISTAKEN
    + f"""SELECT row_id, round(sales_amount, 6) AS sales_amount, CAST(coalesce(sales_amount < s.lo OR sales_amount > s.hi, false) AS INT) AS sales_amount_outlier,
      round(heavy / {_UNIT.format(c='heavy').replace('lo ', 'h.lo ').replace('hi ', 'h.hi ').replace('mid', 'h.mid')}, 6) AS heavy, heavy_outlier FROM f, s, h""",
    "apply_cleaning_units_log": _MISTAKEN
    + f"""SELECT 'sales_amount' AS column_name, 'flag' AS action, 'APPROVED' AS status, count(*) AS rows_affected,
      format('{{}} outliers of ''sales_amount'': flag.', count(*)) AS message FROM f, s WHERE sales_amount < lo OR sales_amount > hi HAVING count(*) > 0
      UNION ALL SELECT 'heavy', 'rescale', 'APPROVED', count(*), format('{{}} outliers of ''heavy'': rescale.', count(*))
      FROM f, h WHERE {_UNIT.format(c='heavy')} > 1 HAVING count(*) > 0
      UNION ALL SELECT NULL, 'drop_duplicates', 'DECLINED/SKIPPED', 0, 'Removal of duplicate rows was not approved.'
      UNION ALL SELECT NULL, 'drop_empty_rows', 'DECLINED/SKIPPED', 0, 'Removal of empty rows was not approved.'""",
    "treat_outliers_nullify": _SALES_BOUNDS
    + "SELECT row_id, CASE WHEN sales_amount >= lo AND sales_amount <= hi THEN round(sales_amount, 4) END AS sales_amount FROM fx_sales, b",
}
