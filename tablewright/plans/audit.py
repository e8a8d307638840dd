"""The record of cleaning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

APPROVED = "APPROVED"
SKIPPED = "DECLINED/SKIPPED"
_SCHEMA = (
    "step int, column_name string, action string, status string, "
    "rows_affected long, value string, message string"
)


class AuditLog:
    """One entry per step, so its size is that of the configuration, not of the data."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []

    def add(
        self,
        column: str | None,
        action: str,
        rows: int = 0,
        status: str = APPROVED,
        value: str | None = None,
        message: str = "",
    ) -> None:
        self._rows.append((len(self._rows), column, action, status, rows, value, message))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self._rows, _SCHEMA)
