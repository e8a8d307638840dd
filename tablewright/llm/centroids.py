"""Centroid clustering with Ptolemaic lower bounds.

Lloyd's rounds over integer vectors. In Euclidean space Ptolemy's inequality holds: for
pivots p and s, d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s). The pivots are the
first starting centroids and stay, so a vector's distances to them are computed once and
kept beside it; a round adds the centroids' distances to the pivots. For each vector the
centroid of the smallest bound is measured first, and then only those whose bound is not
beyond the nearest one so far. Bounds are rounded down and distances are whole numbers, so
nothing is lost.

Every task adds up its own vectors; a row for each task, centroid and round is shuffled, and
only `clusters` centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .vectors import integers, matrix, usable

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
PIVOTS = 8
#: Of distances that float64 holds to the last bit but one or two; bounds give way by more.
SLACK = 1e-12
_CACHED = "vec_id long, v array<int>, pivots array<double>"


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, or of rows and one vector, as whole numbers."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([exact(x, p) for p in pivots], 1).astype(np.float64)) if len(x) else np.zeros((0, len(pivots)))


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """All pairs of different pivots, with their distance."""
    d = [pivot_distances(pivots, pivots[i : i + 1])[:, 0] for i in range(len(pivots))]
    return [(i, j, d[i][j]) for i in range(len(pivots)) for j in range(i) if d[i][j] > 0]


def lower_bounds(near: np.ndarray, centroids: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """For each vector (its distances to the pivots in `near`) and centroid (the same in
    `centroids`) the largest Ptolemaic bound of their squared distance, rounded down."""
    bound = np.zeros((len(near), len(centroids)))
    for i, j, apart in pairs:
        one, other = near[:, i, None] * centroids[None, :, j], near[:, j, None] * centroids[None, :, i]
        gap = np.abs(one - other) - SLACK * (one + other)
        np.maximum(bound, gap / (apart * (1 + SLACK)), out=bound)
    return bound * bound * (1 - SLACK)


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), squared distance, and how
    many distances were measured."""
    bounds = lower_bounds(near, pivot_distances(centroids, pivots), pivot_pairs(pivots))
    first = bounds.argmin(1)
    best = exact(x, centroids[first])
    cluster, measured = first.copy(), len(x)
    for c in range(len(centroids)):
        at = np.flatnonzero((bounds[:, c] <= best) & (first != c))
        if len(at):
            d = exact(x[at], centroids[c])
            better = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
            best[at[better]], cluster[at[better]] = d[better], c
            measured += len(at)
    return cluster, best, measured


def _named(number: int, vector: list[int]) -> tuple[int, str]:
    return number, hashlib.sha256(",".join(map(str, vector)).encode()).hexdigest()


def centroid_clusters(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, scale: int = SCALE
) -> DataFrame:
    """One row per kept vector of `embeddings` (vec_id, embedding; others are ignored): vec_id,
    cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of 64 finite components. Rows that repeat a vec_id are vectors of their
    own; among equal hashes the smaller vector starts first, and a row without vec_id starts
    last. With fewer vectors than `clusters`, each is a centroid; without any there are no
    rows. Components from 2**26 / 64 on raise an error, since distances would not fit.
    """
    spark = embeddings.sparkSession
    v = F.col("embedding")
    rows = embeddings.where(usable(v) & (F.size(v) == WIDTH))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), integers(v, scale).alias("v"))
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = rows.select(key.alias("key"), "v").orderBy(F.col("key").isNull(), "key", "v").limit(clusters).collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, WIDTH)
    fixed = centroids[:pivots].copy()

    def with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pivot_distances(matrix(batch.column("v"), WIDTH), fixed)
            offsets = pa.array(np.arange(len(near) + 1, dtype=np.int32) * len(fixed))
            kept = pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, kept], names=["vec_id", "v", "pivots"])

    cached = written(rows.mapInArrow(with_pivots, _CACHED))

    def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
        for batch in batches:
            x = matrix(batch.column("v"), WIDTH)
            near = batch.column("pivots").flatten().to_numpy().reshape(len(x), len(fixed))
            yield batch, x, *nearest(x, near, centroids, fixed)[:2]

    for _ in range(rounds if len(centroids) else 0):

        def summed(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            for _, x, cluster, _ in assigned(batches, centroids):
                present = np.unique(cluster)
                sums = [x[cluster == c].sum(0).tolist() for c in present]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(present.astype(np.int32)),
                        pa.array(np.bincount(cluster)[present]),
                        pa.array(sums, pa.list_(pa.int64())),
                    ],
                    names=["cluster", "n", "sums"],
                )

        parts = cached.mapInArrow(summed, "cluster int, n long, sums array<long>")
        totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"d{i}") for i in range(WIDTH)]
        moved = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():  # a row per centroid
            moved[r.cluster] = [int(Decimal(r[f"d{i}"])) // r.n for i in range(WIDTH)]
        centroids = moved

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance in assigned(batches, centroids):
            columns = [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    out = written(cached.mapInArrow(placed, "vec_id long, cluster int, distance long"))
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("in_cluster"))
    inertia = {r.cluster: int(r.in_cluster) for r in sums.collect()}  # a row per centroid
    table = [(*_named(i, c), inertia.get(i, 0), sum(inertia.values())) for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(table, "cluster int, centroid_sha256 string, cluster_inertia long, inertia long")
    out = out.join(F.broadcast(names), "cluster")  # `clusters` rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
