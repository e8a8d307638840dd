"""From analysis to cleaning: proposals per column, and the configuration they add up to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ROW_ID, data_types, is_numeric, nan_to_null
from ..operators import missing, outliers
from ..operators.ordering import with_row_id
from ..operators.profile import quality_score

BETWEEN = "Interpolate or Forward Fill"
#: Advice of the cause rules -> action of `apply_cleaning`; other advice needs a person.
MISSING_ACTIONS = {
    "Keep NULL": "keep_null",
    "Preserve NULL": "keep_null",
    "Keep Empty / Do Not Impute": "keep_null",
    "Mark as Pending / Keep NULL": "keep_null",
    "Convert to 'N/A' or Keep NULL": "na_string",
    BETWEEN: "ffill",  # of columns without numbers
    "Forward Fill": "ffill",
    "Median Imputation": "median",
    "Mode Imputation": "mode",
}
OUTLIER_ACTIONS = {
    "Remove or Correct": "remove",
    "Correct or Remove": "remove",
    "Keep (Do NOT Remove)": "keep",
    "Keep Outliers": "keep",
    "Standardize Units / Scale Column": "rescale",
    "Flag for Investigation": "flag",
}
INDICATOR = "Create Missing Indicator Feature"
UNAPPROVED = "skip"


@dataclass(frozen=True)
class Analysis:
    """`table` carries row ids in `row_id`; the frames have one row per column."""

    table: DataFrame
    row_id: str
    score: DataFrame
    missing: DataFrame
    outliers: DataFrame

    def proposals(self) -> DataFrame:
        """(kind, column_name, amount, recommended_action, action, confidence, risk); action is
        null where a person has to decide."""
        gaps = self.missing.select(
            F.lit("missing").alias("kind"), "column_name", F.col("missing_count").alias("amount"), "recommended_action", "confidence", "risk"
        )
        extremes = self.outliers.select(
            F.lit("outliers").alias("kind"), "column_name", F.col("outlier_count").alias("amount"), "recommended_action", "confidence", "risk"
        )
        advice = F.col("recommended_action")
        numbers = [n for n, t in data_types(self.table).items() if is_numeric(t)]
        action = F.when(advice.startswith(INDICATOR), "indicator")
        action = action.when((advice == BETWEEN) & F.col("column_name").isin(numbers), "interpolate")
        for kind, actions in (("missing", MISSING_ACTIONS), ("outliers", OUTLIER_ACTIONS)):
            for words, name in actions.items():
                action = action.when((F.col("kind") == kind) & (advice == words), name)
        return gaps.unionByName(extremes).withColumn("action", action)


def analyse(df: DataFrame, row_id: str | None = None, order_by: tuple[str, ...] = ()) -> Analysis:
    """Missing values and outliers of a table with advice, over one numbering and one set of
    statistics. Without `row_id` rows are numbered by `order_by` or in file order."""
    df = nan_to_null(df)
    if row_id is None:
        row_id = ROW_ID
        df = with_row_id(df, order_by, row_id)
    stats = outliers.outlier_stats(df, row_id=row_id)
    return Analysis(
        df,
        row_id,
        quality_score(df, row_id),
        missing.missing_advice(missing.missing_features(df, row_id)),
        outliers.outlier_advice(outliers.outlier_features(df, row_id, stats)),
    )


def configuration(
    proposals: DataFrame, approved: set[tuple[str, str]] | None = None, duplicates: bool = True, empty_rows: bool = True
) -> dict:
    """The `config` of `apply_cleaning` from proposals (a few rows per column are collected).

    `approved` holds (kind, column_name) pairs; others get the action "skip", and so do
    columns whose advice names no action. None approves all.
    """
    config: dict = {
        "remove_duplicates": duplicates, "remove_empty_rows": empty_rows, "missing_actions": {}, "outlier_actions": {}
    }
    for r in proposals.orderBy("kind", "column_name").collect():
        chosen = r.action if approved is None or (r.kind, r.column_name) in approved else None
        key = "missing_actions" if r.kind == "missing" else "outlier_actions"
        config[key][r.column_name] = chosen or UNAPPROVED
    return config
