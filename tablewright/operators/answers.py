"""Run what a tagged question asks for, and draw what a chosen chart shows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, data_types, nan_to_null
from . import recommend
from .ask import COUNT, aggregate, group_aggregate, group_by_month
from .diagnosis import diagnose
from .profile import completeness_score, duplicate_sample, missing_by_column
from .roles import NUMERICAL, infer_roles, with_role


def answer(df: DataFrame, intent: Mapping, row_id: str | None = None) -> DataFrame | None:
    """The frame that one row of `tag_questions` asks for; None for unknown questions.

    Aggregations give one value, groups and rankings (group, value) rows, duplicates the
    first equal rows (by `row_id` if there is one, else by all columns), missing values one
    row per column, quality the share of filled cells, diagnostic questions `diagnose`.
    """
    kind, target, group = intent["question_type"], intent["target_col"], intent["group_col"]
    if kind == "aggregation":
        return aggregate(df, target, intent["operation"])
    if kind in ("group_by", "top_n"):
        return group_aggregate(df, group, target, intent["operation"], intent["sort"], intent["row_limit"] or None)
    if kind == "duplicates":
        if row_id is not None:
            return duplicate_sample(df, row_id)
        names = [col(n) for n in df.columns]
        rows = nan_to_null(df).groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
        return rows.where("copies > 1").orderBy(*names).limit(10)
    if kind == "missing_values":
        return missing_by_column(df, row_id)
    if kind == "quality_score":
        return completeness_score(df, row_id)
    if kind == "diagnostic":
        return diagnose(df, target, row_id)
    return None


def chart_data(df: DataFrame, chart: str, x_axis: str, y_axis: str, row_id: str | None = None) -> DataFrame:
    """The data of one row of `chart_candidates`."""
    types = data_types(df, row_id)
    if chart == "Line Chart":
        return group_by_month(df, x_axis, y_axis).select(col(x_axis).alias("label"), col(y_axis).alias("value"))
    if chart == "Bar Chart" and y_axis not in types:
        return group_aggregate(df, x_axis).select(col(x_axis).alias("label"), F.col(COUNT).alias("value"))
    if chart in ("Bar Chart", "Geographic Map"):
        return recommend.bar_data(df, x_axis, y_axis)
    if chart == "Pie Chart":
        return recommend.pie_data(df, x_axis)
    if chart == "Scatter Plot":
        return recommend.scatter_data(df, x_axis, y_axis)
    if chart == "Stacked Bar Chart":
        value, by = y_axis.split(" by ", 1)
        return recommend.stacked_data(df, x_axis, value, by)
    if chart == "Histogram":
        return recommend.histogram_data(df, x_axis)
    if chart == "Heatmap":
        return recommend.heatmap_data(df, with_role(infer_roles(df, row_id), NUMERICAL))
    raise ValueError(f"unknown chart {chart!r}")
