"""Where intermediate results are kept, how a plan is cut, and how the copies go again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NOT_IN_PARQUET = (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; where that is unset, a folder in the
    warehouse, which driver and executors share on every master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tablewright"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path inside the shared folder, which `drop_copies` deletes again."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def copies() -> list[str]:
    """Paths of the intermediate tables this process has written and not dropped, in order."""
    return list(_WRITTEN)


def drop_copies(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete intermediate tables (all of this process by default); returns how many.

    Call it when the results made from them are written: frames that still read them fail
    afterwards.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for name in copies() if paths is None else [p for p in paths if p in _WRITTEN]:
        _WRITTEN.remove(name)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(hadoop).delete(path, True))
    return gone


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    Used where several passes must see the same rows (numbering) or where a full
    shuffle would otherwise run again for each pass. The copy is a parquet table,
    so later passes read only the columns they need, and it survives lost
    executors. Columns parquet has no type for are kept by `checkpoint` instead.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if any(isinstance(f.dataType, _NOT_IN_PARQUET) for f in df.schema.fields):
        return df.checkpoint(eager=True)
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
