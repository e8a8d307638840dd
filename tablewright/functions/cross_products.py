"""Correlations of all pairs of columns in one scan.

A task reads its rows once, in Arrow batches, and keeps five matrices of column pairs: how
many rows have both values, both means, both sums of squares around the mean, and the
sums of products. They are products of matrices over a mask of present values, so pairs with
gaps need no pass of their own. Matrices of batches and tasks merge by the parallel form
of the variance, which loses no digits to large means; tasks' matrices travel by rows
and merge in two steps, so no task holds more than FAN of them for one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import col
from .workers import ship

FAN = 64  # matrices that meet in a first merge
_KEYS = ("n", "mx", "my", "sx", "sy", "sxy")
_ARRAYS = ", ".join(f"{k} array<double>" for k in _KEYS)
_FLAT = 1e-13  # a spread this small beside the mean is rounding: the side is constant


def batch_moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of all pairs of the columns of `x`, NaN for missing, as matrices: [a, b] is about
    column a (x) and column b (y) over the rows that have both."""
    there = ~np.isnan(x)
    first = np.argmax(there, 0)
    shift = np.where(there.any(0), x[first, np.arange(x.shape[1])], 0.0)
    d = np.where(there, x - shift, 0.0)
    mask = there.astype(np.float64)
    n = mask.T @ mask
    some = np.maximum(n, 1.0)
    sums = d.T @ mask  # of a where b is there
    squares = (d * d).T @ mask
    spread = np.maximum(squares - sums * sums / some, 0.0)
    spread[spread <= 1e-14 * squares] = 0.0
    mean = sums / some
    return {
        "n": n, "mx": mean + shift[:, None], "my": mean.T + shift[None, :],
        "sx": spread, "sy": spread.T.copy(), "sxy": d.T @ d - sums * sums.T / some,
    }


def merged(one: dict[str, np.ndarray], other: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moments of two disjoint sets of rows together."""
    n = one["n"] + other["n"]
    part = np.where(n > 0, other["n"] / np.maximum(n, 1.0), 0.0)
    dx, dy = other["mx"] - one["mx"], other["my"] - one["my"]
    weight = one["n"] * part
    # Where one side has no rows its means say nothing: weight is 0 there, or `part` is 1.
    return {
        "n": n, "mx": one["mx"] + dx * part, "my": one["my"] + dy * part,
        "sx": one["sx"] + other["sx"] + dx * dx * weight, "sy": one["sy"] + other["sy"] + dy * dy * weight,
        "sxy": one["sxy"] + other["sxy"] + dx * dy * weight,
    }


def _merge_rows(table: pa.Table) -> pa.Table:
    """The rows (part, i, moments) of one group as one row."""
    total = None
    for r in range(table.num_rows):
        now = {k: table.column(k)[r].values.to_numpy() for k in _KEYS}
        total = now if total is None else merged(total, now)
    columns = {"part": table.column("part")[:1], "i": table.column("i")[:1]}
    return pa.table(columns | {k: pa.array([total[k].tolist()], pa.list_(pa.float64())) for k in _KEYS})


def correlations_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, correlation) for every pair i < j of `columns`, by place: Pearson's correlation over
    the rows that have both values; NULL if a side is constant there or no row has both."""
    ship(df.sparkSession)
    k = len(columns)
    numbers = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        with np.errstate(all="ignore"):  # infinite values have no correlation
            for batch in batches:
                if batch.num_rows:
                    parts = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
                    now = batch_moments(np.stack(parts, 1))
                    total = now if total is None else merged(total, now)
        if total is not None:
            part = TaskContext.get().partitionId()
            for i in range(k - 1):
                arrays = [pa.array([total[key][i, i + 1 :].tolist()], pa.list_(pa.float64())) for key in _KEYS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([i], pa.int32()), *arrays], names=["part", "i", *_KEYS]
                )

    schema = f"part int, i int, {_ARRAYS}"
    rows = numbers.mapInArrow(moments, schema).withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
    rows = rows.groupBy("i", "part").applyInArrow(_merge_rows, schema)
    rows = rows.groupBy("i").applyInArrow(_merge_rows, schema)
    pairs = rows.select("i", F.posexplode(F.arrays_zip(*_KEYS)).alias("at", "m"))

    def spread(side: str):
        return F.when(F.sqrt(F.try_divide(F.col(f"m.s{side}"), F.col("m.n"))) > _FLAT * F.abs(F.col(f"m.m{side}")), F.col(f"m.s{side}"))

    ratio = F.try_divide(F.col("m.sxy"), F.sqrt(spread("x")) * F.sqrt(spread("y")))
    ratio = F.when(F.isnan(ratio), ratio).when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    return pairs.select(
        "i", (F.col("i") + F.col("at") + 1).cast("int").alias("j"), F.col("m.n").cast("long").alias("n"), ratio.alias("correlation")
    )
