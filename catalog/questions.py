"""Batches of questions: tags and carried context."""

from tablewright.functions import fixed_values as fv
from tablewright.operators.questions import carry_context, tag_questions

from .common import table

FX_QUESTIONS = "SELECT conv_id, turn, text AS question FROM {conversations}"
COLUMNS = {
    "numeric": ["sales_amount", "quantity", "profit"],
    "categorical": ["category", "region"],
    "temporal": ["order_date"],
}


def questions(s, sf):
    return s.sql(FX_QUESTIONS, conversations=table(s, sf, "conversations"))


QUERIES = {
    "tag_questions": lambda s, sf: tag_questions(questions(s, sf), "question", **COLUMNS).drop("question"),
    "tag_questions_words": lambda s, sf: tag_questions(questions(s, sf), "question", match="word", **COLUMNS).drop("question"),
    "carry_context": lambda s, sf: carry_context(questions(s, sf), "question", "conv_id", "turn", **COLUMNS).drop("question"),
}

def _tags(word_match: bool, context: bool) -> str:
    def says(*words):
        if word_match:
            return "(" + " OR ".join(f"regexp_matches(q, '\\b{w.strip()}\\b')" for w in words) + ")"
        return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"

    carried = (
        "first_value(own IGNORE NULLS) OVER (PARTITION BY conv_id, island ORDER BY turn ROWS UNBOUNDED PRECEDING)"
        if context
        else "own"
    )
    return f"""WITH a AS (SELECT conv_id, turn, lower(question) AS q FROM ({FX_QUESTIONS.format(conversations='conversations')})),
    b AS (SELECT conv_id, turn, q, {says(*fv.DIAGNOSTIC_WORDS)} AS diag, {says(*fv.FOLLOW_UP_PHRASES)} AS follows,
      CASE WHEN {says('sales_amount')} THEN 'sales_amount' WHEN {says('quantity')} THEN 'quantity' WHEN {says('profit')} THEN 'profit'
        WHEN {says(*fv.METRIC_WORDS)} THEN 'sales_amount' END AS target0,
      CASE WHEN {says('category')} THEN 'category' WHEN {says('region')} THEN 'region' WHEN {says(*fv.GROUPING_WORDS)} THEN 'category'
        WHEN {says(*fv.CALENDAR_WORDS)} THEN 'order_date' END AS group0,
      try_cast(nullif(regexp_extract(q, 'top\\s+(\\d+)', 1), '') AS BIGINT) AS lim,
      CASE WHEN {says('total', 'sum')} THEN 'sum' WHEN {says('average', 'avg', 'mean')} THEN 'mean' WHEN {says('count', 'how many')} THEN 'count'
        WHEN {says('highest', 'max', 'maximum', 'peak')} THEN 'max' WHEN {says('lowest', 'min', 'minimum', 'bottom')} THEN 'min' END AS op0,
      {says('contribution', 'share', 'percent', 'pie')} AS pie, {says('duplicate')} AS dup, {says('missing', 'null')} AS miss, {says('quality', 'score')} AS qual FROM a),
    c AS (SELECT *, CASE WHEN diag THEN group0 ELSE coalesce(group0, CASE WHEN lim > 0 THEN 'category' END) END AS own,
      CASE WHEN lim IS NOT NULL THEN coalesce(op0, 'sum') ELSE op0 END AS op,
      CASE WHEN lim IS NOT NULL THEN 'desc' WHEN op0 = 'max' THEN 'desc' WHEN op0 = 'min' THEN 'asc' END AS srt,
      sum((diag OR NOT follows)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM b),
    d AS (SELECT *, {carried} AS g FROM c),
    e AS (SELECT *, coalesce(target0, CASE WHEN diag OR g IS NOT NULL OR op IS NOT NULL THEN 'sales_amount' END) AS target,
      CASE WHEN diag THEN 'diagnostic' WHEN g IS NOT NULL AND lim > 0 THEN 'top_n' WHEN g IS NOT NULL THEN 'group_by' WHEN op IS NOT NULL THEN 'aggregation'
        WHEN dup THEN 'duplicates' WHEN miss THEN 'missing_values' WHEN qual THEN 'quality_score' ELSE 'unknown' END AS question_type FROM d)
    SELECT conv_id, turn, question_type, CASE WHEN NOT diag THEN op END AS operation, CASE WHEN question_type <> 'unknown' THEN target END AS target_col,
      g AS group_col, CASE WHEN NOT diag THEN lim END AS row_limit, CASE WHEN NOT diag THEN srt END AS sort, NOT diag AND g IS NOT NULL AS requires_chart,
      CASE WHEN NOT diag AND g IS NOT NULL THEN CASE WHEN g = 'order_date' THEN 'line' WHEN pie THEN 'pie' ELSE 'bar' END END AS chart_type FROM e"""


ORACLE = {
    "tag_questions": _tags(False, False),
    "tag_questions_words": _tags(True, False),
    "carry_context": _tags(False, True),
}
