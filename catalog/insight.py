"""Roles, cards, charts, answers, diagnosis and story facts."""

from pyspark.sql import functions as F

from tablewright.functions import fixed_values as fv
from tablewright.operators import ask, diagnosis as d, recommend as r, story as t
from tablewright.operators.roles import column_roles

from .common import CTE_FACTS, CTE_SALES, facts, rounded, sales, table

# a table with every role
FX_ROLES = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date, concat('2024-0', o_orderkey % 9 + 1, '-11') AS due_month,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS returned, o_orderkey % 2 AS flag, o_orderstatus = 'F' AS is_final,
  o_orderkey * 3 AS batch_key, o_custkey % 7 AS area_code, o_totalprice AS sales_amount, o_totalprice / 7 AS profit_total,
  o_custkey % 5 AS rating, o_orderpriority AS priority, o_orderstatus AS status, concat('city ', o_custkey % 40) AS city, 'soon' AS time_note
FROM {orders}
"""


def _roles(s, sf):
    return s.sql(FX_ROLES, orders=table(s, sf, "orders"))


def _plain(s, sf):
    """No column a card is made for."""
    return table(s, sf, "part").select("p_name", "p_brand", "p_size")


def _money(df, digits=2):
    return rounded(df, digits)


def _month(df):
    return df.withColumnRenamed("o_orderdate", "month")


QUERIES = {
    "column_roles": lambda s, sf: column_roles(_roles(s, sf)),
    "column_roles_facts": lambda s, sf: column_roles(facts(s, sf)),
    "kpi_cards": lambda s, sf: _money(r.kpi_cards(_roles(s, sf))),
    "kpi_cards_ids": lambda s, sf: _money(r.kpi_cards(_roles(s, sf).drop("sales_amount", "rating"))),
    "kpi_cards_fallback": lambda s, sf: r.kpi_cards(_plain(s, sf)),
    "chart_candidates": lambda s, sf: r.chart_candidates(_roles(s, sf)),
    "chart_candidates_facts": lambda s, sf: r.chart_candidates(facts(s, sf)),
    "chart_bar": lambda s, sf: _money(r.bar_data(facts(s, sf), "region_nation", "sales_amount")),
    "chart_pie": lambda s, sf: r.pie_data(facts(s, sf), "return_flag"),
    "chart_stacked": lambda s, sf: _money(r.stacked_data(facts(s, sf), "return_flag", "sales_amount", "line_status")),
    "chart_histogram": lambda s, sf: _money(r.histogram_data(facts(s, sf), "quantity", 7), 6),
    "chart_heatmap": lambda s, sf: rounded(r.heatmap_data(facts(s, sf), ["sales_amount", "quantity", "discount"]), 6),
    "chart_scatter": lambda s, sf: r.scatter_data(facts(s, sf), "sales_amount", "quantity", 0.05, 7, ["order_id", "line_no"]),
    "aggregate": lambda s, sf: _aggregates(s, sf),
    "group_aggregate": lambda s, sf: _money(ask.group_aggregate(sales(s, sf), "priority", "sales_amount")),
    "group_aggregate_mean": lambda s, sf: rounded(ask.group_aggregate(sales(s, sf), "approval", "sales_amount", "mean")),
    "group_aggregate_count": lambda s, sf: ask.group_aggregate(sales(s, sf), "priority", "sales_amount", "count"),
    "group_by_month": lambda s, sf: _money(_month(ask.group_by_month(table(s, sf, "orders"), "o_orderdate", "o_totalprice"))),
    "top_n": lambda s, sf: _money(ask.top_n(table(s, sf, "orders"), "o_custkey", "o_totalprice", 5)),
    "top_n_count": lambda s, sf: ask.top_n(table(s, sf, "lineitem"), "l_partkey", None, 7, "count"),
    "bottom_n": lambda s, sf: _money(ask.bottom_n(table(s, sf, "orders"), "o_custkey", "o_totalprice", 5, "min")),
    "highest_by_group": lambda s, sf: ask.group_aggregate(facts(s, sf), "region_nation", "sales_amount", "max", "desc"),
    "chart_series_bar": lambda s, sf: _money(ask.chart_series(facts(s, sf), "region_nation", "sales_amount")),
    "chart_series_line": lambda s, sf: _money(ask.chart_series(facts(s, sf), "ship_date", "quantity", chart="line")),
    "chart_series_pie": lambda s, sf: _money(ask.chart_series(facts(s, sf), "region_nation", "sales_amount", chart="pie", sort="desc")),
    "overall_stats": lambda s, sf: _money(d.overall_stats(sales(s, sf), "sales_amount")),
    "monthly_trend": lambda s, sf: _money(d.monthly_trend(sales(s, sf), "order_date", "sales_amount")),
    "segment_breakdown": lambda s, sf: _money(d.segment_breakdown(facts(s, sf), "sales_amount")),
    "segment_breakdown_customer": lambda s, sf: _money(d.segment_breakdown(table(s, sf, "customer"), "c_acctbal")),
    "top_correlation": lambda s, sf: rounded(d.top_correlation(facts(s, sf), "sales_amount"), 6),
    "correlations": lambda s, sf: rounded(d.correlations(sales(s, sf), "sales_amount", row_id="row_id"), 6),
    "diagnose": lambda s, sf: _money(d.diagnose(facts(s, sf), "sales_amount")),
    "segment_story": lambda s, sf: _money(t.segment_story(facts(s, sf), "sales_amount", "return_flag")),
    "peak_trough_month": lambda s, sf: _money(t.peak_trough_month(facts(s, sf), "ship_date", "sales_amount")),
    "half_trend": lambda s, sf: _money(t.half_trend(facts(s, sf), "ship_date", "sales_amount")),
    "top_geo": lambda s, sf: _money(t.top_geo(facts(s, sf), "sales_amount", "region_nation")),
    "data_insights": lambda s, sf: _money(t.data_insights(facts(s, sf))),
}


def _aggregates(s, sf):
    """Every operation over the sales metric, one row each."""
    df, result = sales(s, sf), None
    for op in ("sum", "mean", "max", "min", "count"):
        one = ask.aggregate(df, "sales_amount", op).select(
            F.lit(op).alias("operation"), F.round(F.col("value").cast("double"), 2).alias("value")
        )
        result = one if result is None else result.unionByName(one)
    return result


_ROLES = "WITH t AS (" + FX_ROLES.format(orders="orders") + ") "


def _best(source, label, value="sum(sales_amount)"):
    """A one-row subselect: (label, v) of the largest value."""
    return f"(SELECT {label} AS label, {value} AS v FROM {source} WHERE {label} IS NOT NULL GROUP BY 1 ORDER BY v DESC, label LIMIT 1)"


def _worst(source, label, value="sum(sales_amount)"):
    return f"(SELECT {label} AS label, {value} AS v FROM {source} WHERE {label} IS NOT NULL GROUP BY 1 ORDER BY v, label LIMIT 1)"


def _breakdown(source, target, names):
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS category, (SELECT count(DISTINCT {n}) FROM {source}) AS segments, b.label AS leader, round(b.v, 2) AS leader_total,
          (SELECT round(avg({target}), 2) FROM {source} WHERE {n} = b.label) AS leader_average,
          round(b.v / (SELECT sum({target}) FROM {source} WHERE {n} IS NOT NULL) * 100, 2) AS leader_share, w.label AS laggard, round(w.v, 2) AS laggard_total,
          round(b.v - w.v, 2) AS gap FROM {_best(source, n, f'sum({target})')} b, {_worst(source, n, f'sum({target})')} w"""
        for n in names
    )


_MONTHS = "months AS (SELECT strftime({date}, '%Y-%m') AS m, sum({x}) AS v FROM {t} WHERE {date} IS NOT NULL GROUP BY 1)"
_TREND = """SELECT p.m AS previous_month, l.m AS last_month, round((l.v - p.v) / p.v * 100, 2) AS change_percent,
  CASE WHEN l.v > p.v THEN 'increased' ELSE 'decreased' END AS direction, b.m AS best_month, round(b.v, 2) AS best_value,
  w.m AS worst_month, round(w.v, 2) AS worst_value
  FROM (SELECT * FROM months ORDER BY m DESC LIMIT 1) l, (SELECT * FROM months ORDER BY m DESC LIMIT 1 OFFSET 1) p,
  (SELECT * FROM months ORDER BY v DESC, m LIMIT 1) b, (SELECT * FROM months ORDER BY v, m LIMIT 1) w"""
_FACT_MONTHS = CTE_FACTS + ", " + _MONTHS.format(date="ship_date", x="sales_amount", t="fx_facts")
_CATEGORIES = ["return_flag", "line_status", "supplier_name", "region_nation"]
_HALF = """SELECT round(sum(CASE WHEN n <= h THEN v ELSE 0 END), 2) AS first_half, round(sum(CASE WHEN n > h THEN v ELSE 0 END), 2) AS second_half,
  CASE WHEN sum(CASE WHEN n > h THEN v ELSE -v END) > 0 THEN 'up' WHEN sum(CASE WHEN n > h THEN v ELSE -v END) < 0 THEN 'down' ELSE 'none' END AS trend
  FROM (SELECT v, row_number() OVER (ORDER BY m) AS n, (SELECT count(*) // 2 FROM months) AS h FROM months)"""
_PEAK = """SELECT strftime(strptime(b.m || '-01', '%Y-%m-%d'), '%B %Y') AS best_month, round(b.v, 2) AS best_value,
  strftime(strptime(w.m || '-01', '%Y-%m-%d'), '%B %Y') AS worst_month, round(w.v, 2) AS worst_value
  FROM (SELECT * FROM months ORDER BY v DESC, m LIMIT 1) b, (SELECT * FROM months ORDER BY v, m LIMIT 1) w"""
_STORY = f"""SELECT b.label AS best, round(b.v, 2) AS best_value, round(b.v / (SELECT sum(sales_amount) FROM fx_facts) * 100, 2) AS best_share,
  w.label AS worst, round(w.v, 2) AS worst_value FROM {_best('fx_facts', 'return_flag')} b, {_worst('fx_facts', 'return_flag')} w"""



def _says(words):
    return f"regexp_matches(column_name, '{'|'.join(words)}')"


def _roles_sql(source: str, columns: list[str]) -> str:
    """The role rules over types, names and distinct counts."""
    flags = ", ".join(f"'{w}'" for w in fv.BOOLEAN_WORDS)
    facts = " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{c}' AS column_name, any_value(typeof({c})) AS kind, count(*) AS n, count(DISTINCT {c}) AS u,
          coalesce(bool_and(lower(CAST({c} AS VARCHAR)) IN ({flags})), true) AS flags,
          (SELECT coalesce(bool_or(try_strptime(v, ['%Y-%m-%d', '%Y-%m', '%m/%d/%Y']) IS NOT NULL), false)
            FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {source} WHERE {c} IS NOT NULL LIMIT 10)) AS reads FROM {source}"""
        for i, c in enumerate(columns)
    )
    return f"""SELECT ordinal, column_name, CASE WHEN kind LIKE 'TIMESTAMP%' OR kind = 'DATE' THEN 'Date/Time'
      WHEN {_says(fv.ROLE_DATE_WORDS)} AND (kind <> 'VARCHAR' OR reads) THEN 'Date/Time'
      WHEN kind = 'BOOLEAN' OR u <= 2 AND flags THEN 'Boolean'
      WHEN {_says(fv.ROLE_ID_WORDS)} AND kind NOT IN ('DOUBLE', 'FLOAT') AND (contains(column_name, 'id') OR u > 0.5 * n) THEN 'Identifier'
      WHEN kind <> 'VARCHAR' THEN 'Numerical' ELSE 'Categorical' END AS role FROM ({facts})"""


_ROLE_COLUMNS = """order_id customer_id order_date due_month returned flag is_final batch_key area_code sales_amount profit_total
  rating priority status city time_note""".split()
_FACT_COLUMNS = """order_id line_no ship_date sales_amount quantity discount return_flag line_status supplier_name region_nation""".split()


ORACLE = {
    "column_roles": _ROLES + _roles_sql("t", _ROLE_COLUMNS),
    "column_roles_facts": CTE_FACTS + _roles_sql("fx_facts", _FACT_COLUMNS),
    "kpi_cards": _ROLES
    + """SELECT 0 AS position, 'Total sales_amount' AS name, round(sum(sales_amount), 2) AS value, 'total' AS unit FROM t
      UNION ALL SELECT 1, 'Average sales_amount', round(avg(sales_amount), 2), 'average' FROM t
      UNION ALL SELECT 2, 'Total profit_total', round(sum(profit_total), 2), 'total' FROM t
      UNION ALL SELECT 3, 'Average rating', round(avg(rating), 2), 'average' FROM t""",
    "kpi_cards_ids": _ROLES
    + """SELECT 0 AS position, 'Total profit_total' AS name, round(sum(profit_total), 2) AS value, 'total' AS unit FROM t
      UNION ALL SELECT 1, 'Total Orders', count(DISTINCT order_id), 'count' FROM t
      UNION ALL SELECT 2, 'Total Customers', count(DISTINCT customer_id), 'count' FROM t
      UNION ALL SELECT 3, 'Unique batch_key Count', count(DISTINCT batch_key), 'count' FROM t""",
    "kpi_cards_fallback": """SELECT 0 AS position, 'Total Records' AS name, CAST(count(*) AS DOUBLE) AS value, 'count' AS unit FROM part
      UNION ALL SELECT 1, 'Total Columns', 3.0, 'count'""",
    "chart_candidates": _ROLES
    + """SELECT position, chart, x_axis, y_axis FROM (VALUES (0, 'Line Chart', 'order_date', 'sales_amount'), (1, 'Bar Chart', 'priority', 'sales_amount'),
      (2, 'Pie Chart', 'priority', 'Record Count'), (3, 'Scatter Plot', 'area_code', 'sales_amount'), (4, 'Geographic Map', 'city', 'area_code'),
      (5, 'Stacked Bar Chart', 'priority', 'area_code by status')) v(position, chart, x_axis, y_axis)
      WHERE (SELECT count(DISTINCT priority) BETWEEN 2 AND 6 FROM t)""",
    "chart_candidates_facts": CTE_FACTS
    + """SELECT position, chart, x_axis, y_axis FROM (VALUES (0, 'Line Chart', 'ship_date', 'sales_amount'), (1, 'Bar Chart', 'return_flag', 'sales_amount'),
      (2, 'Pie Chart', 'return_flag', 'Record Count'), (3, 'Scatter Plot', 'line_no', 'sales_amount'), (4, 'Geographic Map', 'region_nation', 'line_no'),
      (5, 'Stacked Bar Chart', 'return_flag', 'line_no by line_status')) v(position, chart, x_axis, y_axis)
      WHERE (SELECT count(DISTINCT return_flag) BETWEEN 2 AND 6 FROM fx_facts)""",
    "chart_bar": CTE_FACTS + "SELECT region_nation AS label, round(sum(sales_amount), 2) AS value FROM fx_facts GROUP BY 1",
    "chart_pie": CTE_FACTS + "SELECT return_flag AS label, count(*) AS value FROM fx_facts GROUP BY 1",
    "chart_stacked": CTE_FACTS
    + "SELECT return_flag AS label, line_status AS part, round(sum(sales_amount), 2) AS value FROM fx_facts GROUP BY 1, 2",
    "chart_histogram": CTE_FACTS
    + """, w AS (SELECT min(quantity) AS lo, (max(quantity) - min(quantity)) / 7 AS width FROM fx_facts)
      SELECT CAST(i AS INT) AS bin, round(lo + i * width, 6) AS lower, round(lo + (i + 1) * width, 6) AS upper,
      (SELECT count(*) FROM fx_facts, w WHERE least(floor((quantity - lo) / width), 6) = i) AS frequency FROM range(7) r(i), w""",
    "chart_scatter": CTE_FACTS
    + """SELECT sales_amount AS x, quantity AS y FROM fx_facts WHERE sales_amount IS NOT NULL AND quantity IS NOT NULL
      AND ('0x' || substr(md5('7:' || order_id || ':' || line_no), 1, 8))::BIGINT < 0.05 * 4294967296""",
    "chart_heatmap": CTE_FACTS
    + """SELECT 'sales_amount' AS x, 'quantity' AS y, round(corr(sales_amount, quantity), 6) AS correlation FROM fx_facts
      UNION ALL SELECT 'sales_amount', 'discount', round(corr(sales_amount, discount), 6) FROM fx_facts
      UNION ALL SELECT 'quantity', 'discount', round(corr(quantity, discount), 6) FROM fx_facts""",
    "aggregate": CTE_SALES
    + """SELECT 'sum' AS operation, round(sum(sales_amount), 2) AS value FROM fx_sales UNION ALL SELECT 'mean', round(avg(sales_amount), 2) FROM fx_sales
      UNION ALL SELECT 'max', round(max(sales_amount), 2) FROM fx_sales UNION ALL SELECT 'min', round(min(sales_amount), 2) FROM fx_sales
      UNION ALL SELECT 'count', CAST(count(sales_amount) AS DOUBLE) FROM fx_sales""",
    "group_aggregate": CTE_SALES + "SELECT priority, round(sum(sales_amount), 2) AS sales_amount FROM fx_sales WHERE priority IS NOT NULL GROUP BY 1",
    "group_aggregate_mean": CTE_SALES + "SELECT approval, round(avg(sales_amount), 4) AS sales_amount FROM fx_sales WHERE approval IS NOT NULL GROUP BY 1",
    "group_aggregate_count": CTE_SALES + 'SELECT priority, count(*) AS "Count" FROM fx_sales WHERE priority IS NOT NULL GROUP BY 1',
    "group_by_month": "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1",
    "top_n": "SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1 ORDER BY sum(orders.o_totalprice) DESC, 1 LIMIT 5",
    "top_n_count": 'SELECT l_partkey, count(*) AS "Count" FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7',
    "bottom_n": "SELECT o_custkey, round(min(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1 ORDER BY min(orders.o_totalprice), 1 LIMIT 5",
    "highest_by_group": CTE_FACTS + "SELECT region_nation, max(sales_amount) AS sales_amount FROM fx_facts GROUP BY 1",
    "chart_series_bar": CTE_FACTS + "SELECT region_nation AS label, round(sum(sales_amount), 2) AS value FROM fx_facts GROUP BY 1 ORDER BY 1 LIMIT 15",
    "chart_series_line": CTE_FACTS + "SELECT strftime(ship_date, '%Y-%m') AS label, round(sum(quantity), 2) AS value FROM fx_facts GROUP BY 1",
    "chart_series_pie": CTE_FACTS
    + """SELECT label, round(v, 2) AS value, round(v * 100 / sum(v) OVER (), 2) AS share FROM (SELECT region_nation AS label, sum(sales_amount) AS v
      FROM fx_facts GROUP BY 1 ORDER BY v DESC, 1 LIMIT 6)""",
    "overall_stats": CTE_SALES + "SELECT round(sum(sales_amount), 2) AS total, round(avg(sales_amount), 2) AS average, count(*) AS row_count FROM fx_sales",
    "monthly_trend": CTE_SALES + ", " + _MONTHS.format(date="order_date", x="sales_amount", t="fx_sales") + _TREND,
    "segment_breakdown": CTE_FACTS + _breakdown("fx_facts", "sales_amount", _CATEGORIES),
    "segment_breakdown_customer": _breakdown("customer", "c_acctbal", ["c_name", "c_mktsegment"]),
    "top_correlation": CTE_FACTS
    + """SELECT column_name, round(r, 6) AS correlation, CASE WHEN abs(r) > 0.6 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength,
      CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (
      SELECT 'order_id' AS column_name, corr(sales_amount, order_id) AS r FROM fx_facts UNION ALL SELECT 'line_no', corr(sales_amount, line_no) FROM fx_facts
      UNION ALL SELECT 'quantity', corr(sales_amount, quantity) FROM fx_facts UNION ALL SELECT 'discount', corr(sales_amount, discount) FROM fx_facts)
      ORDER BY abs(r) DESC LIMIT 1""",
    "correlations": CTE_SALES
    + " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, round(corr(sales_amount, {c}), 6) AS correlation FROM fx_sales"
        for i, c in enumerate(["order_id", "customer_id", "sensor_value", "settled_value"])
    ),
    "diagnose": _FACT_MONTHS
    + f""", tr AS ({_TREND}), seg AS ({_breakdown('fx_facts', 'sales_amount', _CATEGORIES)}),
      places AS (SELECT * FROM (VALUES {", ".join(str((n, i)) for i, n in enumerate(_CATEGORIES, start=2))}) v(category, position))
      SELECT 0 AS position, 'overall' AS section, 'total' AS item, CAST(NULL AS VARCHAR) AS label, round(sum(sales_amount), 2) AS value FROM fx_facts
      UNION ALL SELECT 0, 'overall', 'average', NULL, round(avg(sales_amount), 2) FROM fx_facts UNION ALL SELECT 0, 'overall', 'rows', NULL, count(*) FROM fx_facts
      UNION ALL SELECT 1, 'trend', 'last month', last_month, change_percent FROM tr UNION ALL SELECT 1, 'trend', 'best month', best_month, best_value FROM tr
      UNION ALL SELECT 1, 'trend', 'worst month', worst_month, worst_value FROM tr
      UNION ALL SELECT position, category, 'leader', leader, leader_total FROM seg JOIN places USING (category)
      UNION ALL SELECT position, category, 'leader share', leader, leader_share FROM seg JOIN places USING (category)
      UNION ALL SELECT position, category, 'laggard', laggard, laggard_total FROM seg JOIN places USING (category)
      UNION ALL SELECT position, category, 'gap', NULL, gap FROM seg JOIN places USING (category)
      UNION ALL SELECT 6, 'correlation', CASE WHEN abs(r) > 0.6 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END || CASE WHEN r > 0 THEN ' positive' ELSE ' negative' END,
        column_name, round(r, 2) FROM (SELECT * FROM (
          SELECT 'order_id' AS column_name, corr(sales_amount, order_id) AS r FROM fx_facts UNION ALL SELECT 'line_no', corr(sales_amount, line_no) FROM fx_facts
          UNION ALL SELECT 'quantity', corr(sales_amount, quantity) FROM fx_facts UNION ALL SELECT 'discount', corr(sales_amount, discount) FROM fx_facts)
          ORDER BY abs(r) DESC LIMIT 1)""",
    "segment_story": CTE_FACTS + _STORY,
    "peak_trough_month": _FACT_MONTHS + _PEAK,
    "half_trend": _FACT_MONTHS + _HALF,
    "top_geo": CTE_FACTS + f"SELECT label AS place, round(v, 2) AS value FROM {_best('fx_facts', 'region_nation')}",
    "data_insights": _FACT_MONTHS
    + f""", st AS ({_STORY}), pk AS ({_PEAK}), hf AS ({_HALF})
      SELECT 0 AS position, 'best segment' AS kind, best AS label, best_value AS value, best_share AS share FROM st
      UNION ALL SELECT 1, 'worst segment', worst, worst_value, NULL FROM st UNION ALL SELECT 2, 'best month', best_month, best_value, NULL FROM pk
      UNION ALL SELECT 3, 'worst month', worst_month, worst_value, NULL FROM pk
      UNION ALL SELECT 4, 'trend', trend, round(second_half - first_half, 2), NULL FROM hf WHERE trend <> 'none'
      UNION ALL SELECT 5, 'top place', label, round(v, 2), NULL FROM {_best('fx_facts', 'region_nation')}""",
}
