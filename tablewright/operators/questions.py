"""Tag a table of questions with what they ask for.

Ordered keyword rules over column expressions: a batch of questions is one
projection. With conversation columns, follow-up questions ("what about ...")
take over the group of the question before them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import ROW_ID, col, text_literal
from .ordering import carry_last, with_row_id

INTENT_COLUMNS = [
    "question_type", "operation", "target_col", "group_col", "row_limit", "sort",
    "requires_chart", "chart_type",
]


def _matcher(match: str) -> Callable[[Sequence[str]], str]:
    """words -> SQL: does the lowered text mention one of them?"""
    if match == "substring":
        # a word around another one of the list adds nothing to the list
        return lambda words: "(" + " OR ".join(
            f"contains(_tw_text, {text_literal(w)})" for w in words if not any(v != w and v in w for v in words)
        ) + ")"
    if match == "word":
        return lambda words: (
            "(_tw_text RLIKE " + text_literal(r"\b(" + "|".join(re.escape(w.strip()) for w in words) + r")\b") + ")"
        )
    raise ValueError(f"unknown match {match!r}")


def _first_of(options: Sequence[tuple[str, str | None]]) -> str:
    """SQL for the value of the first condition that holds."""
    branches = [
        f"WHEN {condition} THEN {'NULL' if value is None else text_literal(value)}" for condition, value in options
    ]
    return f"CAST(CASE {' '.join(branches)} END AS STRING)" if branches else "CAST(NULL AS STRING)"


def tag_questions(
    questions: DataFrame,
    text: str,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    temporal: Sequence[str] = (),
    conversation: str | None = None,
    turn: str | None = None,
    match: str = "substring",
) -> DataFrame:
    """Add the intent columns to a table of questions.

    `numeric`, `categorical` and `temporal` name the columns of the table the
    questions are about. `match="word"` asks for whole words; the default finds
    words inside other words, too.
    """
    mentions = _matcher(match)
    metric = numeric[0] if numeric else None
    category = categorical[0] if categorical else None

    target = _first_of(
        [(mentions([n.lower()]), n) for n in numeric] + [(mentions(fv.METRIC_WORDS), metric)]
    )
    group_options = [(mentions([n.lower()]), n) for n in categorical]
    if categorical:
        group_options.append((mentions(fv.GROUPING_WORDS), category))
    if temporal:
        group_options.append((mentions(fv.CALENDAR_WORDS), temporal[0]))
    words = fv.OPERATION_WORDS
    topics = [
        (mentions(["duplicate"]), "duplicates"),
        (mentions(["missing", "null"]), "missing_values"),
        (mentions(["quality", "score"]), "quality_score"),
    ]
    parsed = questions.select(
        "*", F.coalesce(F.lower(col(text)), F.lit("")).alias("_tw_text")
    ).selectExpr(
        "*",
        f"try_cast(regexp_extract(_tw_text, {text_literal(fv.TOP_N_PATTERN)}, 1) AS BIGINT) AS _tw_limit",
        f"{mentions(fv.DIAGNOSTIC_WORDS)} AS _tw_diagnostic",
        f"{mentions(fv.FOLLOW_UP_PHRASES)} AS _tw_follows",
        f"{target} AS _tw_target",
        f"{_first_of(group_options)} AS _tw_group",
        f"{_first_of([(mentions(w), op) for op, w, _ in words])} AS _tw_spoken",
        f"{_first_of([(mentions(w), s) for _, w, s in words])} AS _tw_order",
        f"{mentions(fv.PIE_WORDS)} AS _tw_pie",
        f"{_first_of(topics)} AS _tw_topic",
    ).selectExpr(
        "* EXCEPT (_tw_text, _tw_spoken, _tw_order)",
        "CASE WHEN _tw_limit IS NOT NULL THEN coalesce(_tw_spoken, 'sum') ELSE _tw_spoken END AS _tw_op",
        "CASE WHEN _tw_limit IS NOT NULL THEN 'desc' ELSE _tw_order END AS _tw_sort",
    )
    limited = F.coalesce(F.col("_tw_limit") > 0, F.lit(False))
    own = F.when(F.col("_tw_diagnostic"), F.col("_tw_group")).otherwise(
        F.coalesce("_tw_group", F.when(limited, F.lit(category)))
    )
    parsed = parsed.withColumn("_tw_group", own)
    if conversation is not None:
        parsed = _carry_group(parsed, conversation, turn)
    return _classify(parsed, questions.columns, metric, temporal)


def _carry_group(parsed: DataFrame, conversation: str, turn: str) -> DataFrame:
    """Follow-up questions take the group of the question before them.

    Rows are numbered over all conversations and handled in equal blocks, so a
    conversation of any length is spread over tasks. A question that does not
    follow up starts afresh; after it, the first group that is named holds for
    the follow-ups behind it.
    """
    numbered = with_row_id(parsed, [conversation, turn])
    here, row = col(conversation), F.col(ROW_ID)
    fresh = F.col("_tw_diagnostic") | ~F.col("_tw_follows")
    named = F.col("_tw_group").isNotNull()
    place = F.struct(here.alias("c"), row.alias("r"))
    first = carry_last(
        numbered,
        {"_tw_fresh": F.when(fresh, place)},
        before={"_tw_named": F.when(named, place)},
    )
    start = F.coalesce(F.when(F.col("_tw_fresh.c") == here, F.col("_tw_fresh.r")), F.lit(-1))
    already = (F.col("_tw_named.c") == here) & (F.col("_tw_named.r") >= start)
    opened = first.withColumns(
        {"_tw_start": start, "_tw_opens": named & ~F.coalesce(already, F.lit(False))}
    )
    value = F.struct(here.alias("c"), row.alias("r"), F.col("_tw_group").alias("g"))
    held = carry_last(opened, {"_tw_held": F.when(F.col("_tw_opens"), value)})
    valid = (F.col("_tw_held.c") == here) & (F.col("_tw_held.r") >= F.col("_tw_start"))
    return held.withColumn("_tw_group", F.when(valid, F.col("_tw_held.g")))


def _classify(parsed: DataFrame, keep: Sequence[str], metric: str | None, temporal: Sequence[str]) -> DataFrame:
    diagnostic, group = F.col("_tw_diagnostic"), F.col("_tw_group")
    op, limit = F.col("_tw_op"), F.col("_tw_limit")
    limited = F.coalesce(limit > 0, F.lit(False))
    filled = F.coalesce(
        F.col("_tw_target"), F.when(diagnostic | group.isNotNull() | op.isNotNull(), F.lit(metric))
    )
    kind = (
        F.when(diagnostic, "diagnostic")
        .when(group.isNotNull() & limited, "top_n")
        .when(group.isNotNull(), "group_by")
        .when(op.isNotNull() & filled.isNotNull(), "aggregation")
        .otherwise(F.coalesce("_tw_topic", F.lit("unknown")))
    )
    typed = parsed.withColumns({"question_type": kind, "_tw_filled": filled})
    known = F.col("question_type") != "unknown"
    plain = known & ~diagnostic
    charted = plain & group.isNotNull()
    chart = (
        F.when(group.isin(list(temporal)), "line").when(F.col("_tw_pie"), "pie").otherwise("bar")
        if temporal
        else F.when(F.col("_tw_pie"), "pie").otherwise("bar")
    )
    return typed.select(
        *[col(n) for n in keep],
        "question_type",
        F.when(plain, op).alias("operation"),
        F.when(known, F.col("_tw_filled")).alias("target_col"),
        F.when(known, group).alias("group_col"),
        F.when(plain, limit).alias("row_limit"),
        F.when(plain, F.col("_tw_sort")).alias("sort"),
        charted.alias("requires_chart"),
        F.when(charted, chart).alias("chart_type"),
    )


def carry_context(
    questions: DataFrame, text: str, conversation: str, turn: str, **columns: Sequence[str]
) -> DataFrame:
    """`tag_questions` with follow-ups resolved inside each conversation."""
    return tag_questions(questions, text, conversation=conversation, turn=turn, **columns)
