"""Reading the given tables, cutting plans, Arrow batches: shared by the operators here."""

from __future__ import annotations

import ctypes
import gc
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.storage import materialise

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of the Arrow batches that go to Python and back: copies of a few of them are held by each
#: task on both sides, outside the heap. Operators cut texts into slices of 1 to 4 MB anyway.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_SHIPPED: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH bytes in this session, unless it has a size of its own."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def ship(spark: SparkSession) -> None:
    """Send this library to the executors once, as `--py-files` does."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        _SHIPPED.add(spark.sparkContext.applicationId)
        root = Path(__file__).resolve().parents[2]
        name = str(Path(tempfile.mkdtemp()) / "tablewright")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "tablewright"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder: later steps don't repeat what made them."""
    return materialise(df)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of frames that are gone. It does so when the
    driver collects garbage, which a driver with little to do may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(text):
    """A-Z lower-cased and nothing else. `lower` does the same where all is ASCII, and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of `column`, so that memory follows
    one text at most, however many long texts a batch holds."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def lean(function: Callable[..., Iterator[pa.RecordBatch]], tokens: bool = False) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches that gives freed memory back when it ends: workers live on for
    other stages, and allocators keep what they once had. Unless it makes `tokens` itself, it
    first drops the words that tokenizing has left in its worker."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None if tokens else sys.modules.get("tablewright.llm.tokens")
        if left:
            left.words_of.cache_clear()
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
