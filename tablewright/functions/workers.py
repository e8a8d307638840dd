"""Python functions on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the executors once, as `--py-files` does."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        _SHIPPED.add(spark.sparkContext.applicationId)
        root = Path(__file__).resolve().parents[2]
        name = str(Path(tempfile.mkdtemp()) / "tablewright")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "tablewright"))
