"""Analysis to proposals to cleaning, and answers to tagged questions."""

from pyspark.sql import functions as F

from tablewright.operators.answers import answer, chart_data
from tablewright.plans.approved import apply_cleaning
from tablewright.plans.proposals import analyse, configuration

from . import missing, outliers, profile
from .common import CTE_DUPS, CTE_SALES, dups, rounded, sales, table

_ACTION = """CASE WHEN recommended_action LIKE 'Create Missing Indicator Feature%' THEN 'indicator' ELSE CASE recommended_action
  WHEN 'Keep NULL' THEN 'keep_null' WHEN 'Preserve NULL' THEN 'keep_null' WHEN 'Keep Empty / Do Not Impute' THEN 'keep_null'
  WHEN 'Mark as Pending / Keep NULL' THEN 'keep_null' WHEN 'Convert to ''N/A'' or Keep NULL' THEN 'na_string'
  WHEN 'Interpolate or Forward Fill' THEN if(column_name IN ('sensor_value', 'settled_value'), 'interpolate', 'ffill') WHEN 'Forward Fill' THEN 'ffill' WHEN 'Median Imputation' THEN 'median'
  WHEN 'Mode Imputation' THEN 'mode' END END"""


def _gaps(s, sf):
    return s.sql(missing.FX_GAPS, orders=table(s, sf, "orders"))


def _proposals(s, sf):
    rows = analyse(_gaps(s, sf), order_by=("row_id",)).proposals()
    return rows.where("kind = 'missing' AND column_name <> 'row_id'").select("column_name", "amount", "recommended_action", "action")


def _outlier_proposals(s, sf):
    rows = analyse(outliers.extremes(s, sf), "row_id").proposals()
    return rows.where("kind = 'outliers'").drop("kind")


def _apply_proposals(s, sf):
    """The proposals for orders' priorities and prices, applied as they are."""
    df = table(s, sf, "orders").selectExpr(
        "o_orderkey AS row_no", "o_orderkey AS order_key",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS worth",
    )
    found = analyse(df, "row_no")
    config = configuration(found.proposals(), {("missing", "priority"), ("missing", "worth")})
    return rounded(apply_cleaning(found.table, config, "row_no").table, 4)


def _intent(kind, target=None, group=None, operation=None, limit=None, sort=None):
    return {
        "question_type": kind, "target_col": target, "group_col": group, "operation": operation, "row_limit": limit, "sort": sort
    }


QUERIES = {
    "proposals": _proposals,
    "proposals_outliers": _outlier_proposals,
    "apply_proposals": _apply_proposals,
    "answer_aggregation": lambda s, sf: rounded(answer(sales(s, sf), _intent("aggregation", "sales_amount", operation="mean"))),
    "answer_group_by": lambda s, sf: rounded(answer(sales(s, sf), _intent("group_by", "sales_amount", "status", "sum")), 2),
    "answer_top_n": lambda s, sf: answer(sales(s, sf), _intent("top_n", "sales_amount", "customer_id", "count", 5, "desc")),
    "answer_duplicates": lambda s, sf: rounded(answer(dups(s, sf), _intent("duplicates"))),
    "answer_missing_values": lambda s, sf: answer(sales(s, sf), _intent("missing_values"), "row_id").select(
        "column_name", "missing_count"
    ),
    "answer_quality_score": lambda s, sf: rounded(answer(sales(s, sf), _intent("quality_score"), "row_id")),
    "answer_diagnostic": lambda s, sf: rounded(
        answer(sales(s, sf).select("row_id", "sales_amount", "status"), _intent("diagnostic", "sales_amount"), "row_id")
        .where("section = 'overall'")
        .select("item", "value"),
        2,
    ),
    "chart_line": lambda s, sf: rounded(chart_data(sales(s, sf), "Line Chart", "order_date", "sales_amount"), 2),
    "chart_map": lambda s, sf: chart_data(table(s, sf, "customer").withColumn("one", F.lit(1)), "Geographic Map", "c_nationkey", "one"),
}

_SALES_NULLS = "order_id customer_id order_date sales_amount priority status approval sensor_value settled_value".split()

ORACLE = {
    "proposals_outliers": f"""SELECT column_name, outlier_count AS amount, recommended_action, confidence, risk, CASE recommended_action
      WHEN 'Flag for Investigation' THEN 'flag' WHEN 'Standardize Units / Scale Column' THEN 'rescale' WHEN 'Remove or Correct' THEN 'remove'
      WHEN 'Correct or Remove' THEN 'remove' WHEN 'Keep (Do NOT Remove)' THEN 'keep' END AS action FROM ({outliers.ORACLE['outlier_advice']})""",
    "proposals": f"SELECT column_name, missing_count AS amount, recommended_action, {_ACTION} AS action FROM ({missing.ORACLE['missing_advice']})",
    "apply_proposals": """WITH x AS (SELECT o_orderkey AS row_no, o_orderkey AS order_key,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS worth FROM orders)
      SELECT row_no, order_key, coalesce(priority, (SELECT priority FROM x WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority,
        round(coalesce(worth, (SELECT median(worth) FROM x)), 4) AS worth FROM x""",
    "answer_aggregation": CTE_SALES + "SELECT round(avg(sales_amount), 4) AS value FROM fx_sales",
    "answer_group_by": CTE_SALES + "SELECT status, round(sum(sales_amount), 2) AS sales_amount FROM fx_sales GROUP BY status",
    "answer_top_n": CTE_SALES
    + """SELECT customer_id, count(*) AS "Count" FROM fx_sales GROUP BY customer_id ORDER BY 2 DESC, 1 LIMIT 5""",
    "answer_duplicates": CTE_DUPS
    + """SELECT order_id, customer_id, priority, round(sales_amount, 4) AS sales_amount, count(*) AS copies FROM fx_dups GROUP BY ALL HAVING count(*) > 1
      ORDER BY order_id NULLS FIRST, customer_id NULLS FIRST, priority NULLS FIRST, sales_amount NULLS FIRST LIMIT 10""",
    "answer_missing_values": CTE_SALES
    + " SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count FROM fx_sales" for c in _SALES_NULLS)
    + ") WHERE missing_count > 0",
    "answer_quality_score": profile.ORACLE["completeness_score"],
    "answer_diagnostic": CTE_SALES
    + """SELECT unnest(['total', 'average', 'rows']) AS item, round(unnest([sum(sales_amount), avg(sales_amount), count(*)]), 2) AS value FROM fx_sales""",
    "chart_line": CTE_SALES
    + "SELECT strftime(order_date, '%Y-%m') AS label, round(coalesce(sum(sales_amount), 0), 2) AS value FROM fx_sales GROUP BY 1",
    "chart_map": "SELECT c_nationkey AS label, count(*) AS value FROM customer GROUP BY 1",
}
