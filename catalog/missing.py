"""Why values are missing: features, causes, advice."""

from tablewright.functions import fixed_values as fv
from tablewright.operators import missing as m
from tablewright.operators.cleaning import interpolate

from .common import rounded, table

# one column per kind of gap, named so that every cause rule can apply
FX_GAPS = """
SELECT o_orderkey AS row_id, o_orderstatus AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('note ', o_custkey) END AS notes,
  CASE WHEN o_orderkey % 4 <> 0 THEN NULL ELSE o_totalprice / 100 END AS bonus,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat('n', o_custkey) END AS spouse_name,
  CASE WHEN o_orderkey > (SELECT max(o_orderkey) - 5 FROM {orders}) OR o_orderkey % 41 = 7 THEN NULL ELSE o_orderdate END AS due_date,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END AS event_time,
  CASE WHEN o_orderkey BETWEEN 100 AND 119 OR o_orderkey = 121 THEN NULL ELSE o_totalprice / 10 END AS sensor_value,
  CASE WHEN o_orderkey > (SELECT max(o_orderkey) - 20 FROM {orders}) THEN NULL ELSE o_totalprice * 2 END AS settled_value,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_totalprice END AS salary,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN NULL ELSE concat(o_orderstatus, '-ok') END AS approval,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS amount
FROM {orders}
"""
GAPS = [
    "status", "priority", "notes", "bonus", "spouse_name", "due_date", "event_time", "sensor_value",
    "settled_value", "salary", "approval", "amount",
]
_NUMERIC = ["bonus", "sensor_value", "settled_value", "salary", "amount"]
_TEMPORAL = ["due_date", "event_time"]
_SEGMENTS = ["status", "priority", "approval"]


def gaps(spark, sf):
    return spark.sql(FX_GAPS, orders=table(spark, sf, "orders"))


def _by_time(s, sf):
    """Event values with gaps and some rows without a time."""
    df = table(s, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 17 <> 3 THEN ts END AS ts", "CASE WHEN event_id % 5 < 2 THEN value END AS value"
    )
    return interpolate(df, ["value"], "event_id", by="ts", edges=False, block_rows=1000)


def _features(s, sf):
    return m.missing_features(gaps(s, sf), "row_id")


QUERIES = {
    "missing_summary": lambda s, sf: rounded(m.missing_summary(gaps(s, sf), "row_id")),
    "longest_null_run": lambda s, sf: m.longest_null_run(gaps(s, sf), "row_id", block_rows=1000),
    "missing_at_edges": lambda s, sf: m.missing_at_edges(gaps(s, sf), "row_id"),
    "missing_tail_only": lambda s, sf: m.missing_tail_only(gaps(s, sf), "row_id"),
    "missing_by_segment": lambda s, sf: rounded(m.missing_by_segment(gaps(s, sf), "row_id")),
    "missing_association": lambda s, sf: rounded(m.missing_association(gaps(s, sf), "row_id"), 5),
    "missing_causes": lambda s, sf: m.missing_causes(_features(s, sf)).select("column_name", "cause_order", "cause", "confidence"),
    "missing_advice": lambda s, sf: rounded(m.missing_advice(_features(s, sf))),
    "interpolate": lambda s, sf: rounded(
        interpolate(gaps(s, sf), _NUMERIC, "row_id", block_rows=1000).select("row_id", *_NUMERIC), 6
    ),
    "interpolate_by_time": lambda s, sf: rounded(_by_time(s, sf), 6),
}

_ROWS = "(SELECT count(*) FROM gaps)"


def _per_column(sql: str) -> str:
    return " UNION ALL ".join(
        sql.format(
            c=c, n=c in _NUMERIC, t=c in _TEMPORAL or "date" in c or "time" in c
        )
        for c in GAPS
    )


_BASE = "WITH gaps AS (" + FX_GAPS.format(orders="orders") + """),
runs AS (SELECT column_name, max(len) AS longest_run FROM ("""
_BASE += " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS len FROM (
      SELECT row_id - row_number() OVER (ORDER BY row_id) AS island FROM gaps WHERE {c} IS NULL) GROUP BY island"""
    for c in GAPS
)
_BASE += ") GROUP BY column_name), segs AS ("
_BASE += " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{g}' AS segment_column, {g} AS segment, count(*) AS segment_rows, count(*) - count({c}) AS missing_count
      FROM gaps WHERE {g} IS NOT NULL GROUP BY {g} HAVING count(*) - count({c}) > 0.5 * count(*) AND count(*) > 3"""
    for c in GAPS
    for g in _SEGMENTS
    if c != g
)
_BASE += "), f AS (" + _per_column(
    """SELECT '{c}' AS column_name, {n} AS is_numeric, {t} AS is_temporal, count(*) - count({c}) AS missing_count,
      (count(*) - count({c})) / count(*) * 100 AS missing_percent,
      {t} AND arg_min({c} IS NULL, row_id) AS missing_at_start, {t} AND arg_max({c} IS NULL, row_id) AS missing_at_end,
      NOT {t} AND coalesce(max(row_id) FILTER ({c} IS NOT NULL) < min(row_id) FILTER ({c} IS NULL), true) AS missing_tail_only
    FROM gaps HAVING count(*) > count({c})"""
) + "), ff AS (SELECT f.*, longest_run, (SELECT count(*) FROM segs WHERE segs.column_name = f.column_name) AS segments FROM f JOIN runs USING (column_name)) "



def _named(words):
    return f"regexp_matches(column_name, '{'|'.join(words)}')"


# the rule table of the specification: order, cause, condition, confidence of the cause
_RULES = [
    (1, "Cause I: Excessive Missingness", "missing_percent >= 50", "High"),
    (2, "Cause I: Excessive Missingness", "missing_percent >= 20 AND missing_percent < 50", "Medium"),
    (3, "Cause C: Intentionally Left Blank", _named(fv.OPTIONAL_WORDS), "High"),
    (4, "Cause D: Not Applicable", _named(fv.NOT_APPLICABLE_WORDS), "High"),
    (5, "Cause E: Future Placeholder Data", "is_temporal AND missing_at_end", "Medium"),
    (6, "Cause B: System Failure", "longest_run >= 10", "Medium"),
    (7, "Cause F: Data Still Being Collected", "missing_tail_only", "Medium"),
    (8, "Cause G: Privacy or Compliance Removal", _named(fv.SENSITIVE_WORDS), "Medium"),
    (9, "Cause H: Missingness Has Predictive Value", "segments > 0", "High"),
]
_ANY = " OR ".join(f"({c})" for _, _, c, _ in _RULES)
_COND = {number: c for number, _, c, _ in _RULES}


def _side(c, place, side):
    """The last value (or place) at or before a row, or the first one at or after it."""
    known = f"CASE WHEN {c} IS NOT NULL AND {place} IS NOT NULL THEN"
    name, rows = {"before": ("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), "after": ("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")}[side]
    over = "OVER (ORDER BY {row} ROWS BETWEEN " + rows + ")"
    return [f"{name}({known} {x} END IGNORE NULLS) {over} AS {c}_{side}_{k}" for x, k in ((c, "v"), (place, "p"))]


def _line(c, place, edge="coalesce({c}_before_v, {c}_after_v)"):
    between = f"{c}_before_v + ({c}_after_v - {c}_before_v) * coalesce(({place} - {c}_before_p) / nullif({c}_after_p - {c}_before_p, 0), 0)"
    return (
        f"round(CASE WHEN {c} IS NOT NULL OR {place} IS NULL THEN {c} "
        f"WHEN {c}_before_v IS NOT NULL AND {c}_after_v IS NOT NULL THEN {between} ELSE {edge.format(c=c)} END, 6) AS {c}"
    )


ORACLE = {
    "interpolate": "WITH gaps AS ("
    + FX_GAPS.format(orders="orders")
    + "), sides AS (SELECT *, "
    + ", ".join(x.format(row="row_id") for c in _NUMERIC for side in ("before", "after") for x in _side(c, "row_id", side))
    + " FROM gaps) SELECT row_id, "
    + ", ".join(_line(c, "row_id") for c in _NUMERIC)
    + " FROM sides",
    "interpolate_by_time": """WITH e AS (SELECT event_id, CASE WHEN event_id % 17 <> 3 THEN ts END AS ts,
        CASE WHEN event_id % 17 <> 3 THEN CAST(epoch_us(ts) AS DOUBLE) END AS micros, CASE WHEN event_id % 5 < 2 THEN value END AS value FROM events),
      sides AS (SELECT *, """
    + ", ".join(x.format(row="event_id") for side in ("before", "after") for x in _side("value", "micros", side))
    + f" FROM e) SELECT event_id, ts, {_line('value', 'micros', 'NULL')} FROM sides",
    "missing_summary": _BASE + "SELECT column_name, missing_count, round(missing_percent, 4) AS missing_percent FROM f",
    "longest_null_run": _BASE + "SELECT * FROM runs",
    "missing_at_edges": _BASE + "SELECT column_name, is_temporal, missing_at_start, missing_at_end FROM f",
    "missing_tail_only": _BASE + "SELECT column_name, missing_tail_only FROM f",
    "missing_by_segment": _BASE
    + "SELECT column_name, segment_column, segment, segment_rows, missing_count, round(missing_count / segment_rows * 100, 4) AS missing_percent FROM segs",
    # Chi-square by its definition: observed against expected counts of both rows of the table.
    "missing_association": _BASE
    + ", cells AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS c, '{g}' AS g, {g} AS v, count(*) AS r, count(*) - count({c}) AS m FROM gaps WHERE {g} IS NOT NULL GROUP BY {g}"
        for c in GAPS if c != "status" for g in _SEGMENTS if c != g
    )
    + """), t AS (SELECT *, sum(r) OVER w AS n, sum(m) OVER w AS tm FROM cells WINDOW w AS (PARTITION BY c, g)),
      x AS (SELECT c, g, count(*) AS segments, any_value(n)::BIGINT AS rows, any_value(tm)::BIGINT AS missing_count,
        sum((m - r * tm / n) ^ 2 / (r * tm / n) + ((r - m) - r * (n - tm) / n) ^ 2 / (r * (n - tm) / n)) FILTER (tm > 0 AND tm < n) AS chi FROM t GROUP BY c, g)
      SELECT c AS column_name, g AS segment_column, segments, rows, missing_count, round(CASE WHEN segments > 1 THEN chi END, 5) AS chi_square,
        round(CASE WHEN segments > 1 THEN sqrt(chi / rows) END, 5) AS cramers_v FROM x""",
    "missing_causes": _BASE
    + " UNION ALL ".join(
        f"SELECT column_name, {i} AS cause_order, '{cause}' AS cause, '{sure}' AS confidence FROM ff WHERE {condition}"
        for i, cause, condition, sure in _RULES
    )
    + f" UNION ALL SELECT column_name, 10, 'Cause A: Data Entry Error', 'Medium' FROM ff WHERE NOT ({_ANY})",
    # the last rule that replaces everything decides; the "only while Keep NULL" rules count if none does
    "missing_advice": _BASE
    + f"""SELECT column_name, missing_count, round(missing_percent, 4) AS missing_percent, longest_run, is_temporal, missing_at_start, missing_at_end,
      split_part(advice, '#', 1) AS recommended_action, split_part(advice, '#', 2) AS confidence, split_part(advice, '#', 3) AS risk
    FROM (SELECT *, CASE
      WHEN {_COND[9]} THEN 'Create Missing Indicator Feature (e.g. ' || column_name || '_missing = 1)#High#Low'
      WHEN {_COND[8]} THEN 'Preserve NULL#Medium#Low'
      WHEN {_COND[7]} THEN 'Mark as Pending / Keep NULL#Medium#Medium'
      WHEN {_COND[6]} THEN 'Interpolate or Forward Fill#Medium#Medium'
      WHEN {_COND[1]} THEN 'Request User Review / Drop Column#High#High'
      WHEN {_COND[2]} THEN 'Request User Review#Medium#Medium'
      WHEN {_COND[4]} THEN 'Convert to ''N/A'' or Keep NULL#High#Low'
      WHEN {_COND[5]} THEN 'Keep Empty / Do Not Impute#High#Low'
      WHEN {_COND[3]} THEN 'Keep NULL#High#Low'
      WHEN is_numeric THEN 'Median Imputation#Medium#Low' WHEN is_temporal THEN 'Forward Fill#Medium#Low'
      ELSE 'Mode Imputation#Medium#Low' END AS advice FROM ff)""",
}
