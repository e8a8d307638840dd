"""Hard negatives and centroid clusters, against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import centroids, negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_vectors(width=64, n=420):
    """Copies, ties, opposite and zero vectors, repeated ids, rows that take no part."""
    rng = random.Random(11)
    as_float = lambda x: float(np.float32(x))
    base = [[as_float(rng.gauss(0, 0.125)) for _ in range(width)] for _ in range(n)]
    rows = []
    for i, v in enumerate(base):
        kind = i % 11
        if kind == 3:
            v = base[i - 3]
        elif kind == 5:
            v = [as_float(x * 0.99) for x in base[0]]
        elif kind == 7 and i > 100:
            v = [as_float(-x) for x in base[i - 50]]
        rows.append((i, v, i % 3 if kind else 1))
    rows += [(n, [0.0] * width, 2), (n + 1, [as_float(0.25)] * width, -7), (7, base[9], 1), (50, base[60], 0), (50, base[60], 0)]
    odd = [None, [], [1.0], [0.5] * (width + 1), [math.nan] * width, [math.inf] + [0.0] * (width - 1), [None] + [0.0] * (width - 1)]
    rows += [(n + 10 + i, v, i % 3) for i, v in enumerate(odd)]
    return [*rows, (n + 30, base[1], None), (None, base[2], 1), (n - n % 50 + 50, base[3], 1)]


def floors(v, scale):
    return [math.floor(scale * x) for x in v]


def is_whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def negatives_expected(rows):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and is_whole(v):
            kept.append((i, floors(v, 256), math.fmod(label + 1, 10) if i % 7 == 0 else label))
    out = []
    for i, v, label in kept:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in kept if j != i]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = sorted(s[:2] for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out += [(i, j, rank + 1, k, -p, -s) for rank, (s, k) in enumerate(inside[:3])]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("block_rows, anchor_rows", [(1 << 16, 1 << 14), (13, 3)])
def test_hard_negatives(spark, block_rows, anchor_rows):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"anchor": F.lit(1), "window": F.lit("x"), "v": F.lit(2)})
    got = negatives.hard_negatives(df, block_rows, anchor_rows, 2).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == negatives_expected(rows)


def test_hard_negatives_of_large_whole_numbers(spark):
    """Sums beyond float32 and float64."""
    rng = random.Random(2)
    for size in (100.0, 200_000.0):
        rows = [(i, [rng.choice((1.0, -1.0)) * size + rng.randrange(9) / 8 for _ in range(9)], i % 2) for i in range(120)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        assert sorted(map(tuple, negatives.hard_negatives(df).select(COLUMNS).collect())) == negatives_expected(rows)
    with pytest.raises(Exception, match="a component times"):
        negatives.hard_negatives(spark.createDataFrame([(0, [1e9], 1)], SCHEMA)).collect()


def test_bounds_leave_the_first_rows_in(spark):
    rng = np.random.default_rng(4)
    for n, width in ((1, 3), (40, 8), (500, 33)):
        columns = rng.integers(-90, 90, (width, n))
        columns[:, n // 2 :] = columns[:, : n - n // 2]
        block = negatives.Block.of(np.arange(n) % 37, np.sort(rng.integers(0, 3, n)), columns)
        for _ in range(20):
            a = rng.integers(-90, 90, width) * rng.integers(0, 2, width)
            scores = a @ columns
            low, high = sorted(rng.choice(scores, 2).tolist())
            windows = [(low, high, 3), (-(1 << 62), 1 << 62, 5)]
            cuts = sorted(rng.integers(0, n + 1, 2).tolist())
            rows = [s for s in (slice(0, cuts[0]), slice(cuts[1], n)) if s.stop > s.start]
            if not rows:
                continue
            counts = np.zeros(n, bool)
            for s in rows:
                counts[s] = True
            found = negatives.scan(block, block.read_as(float(np.sqrt((a * a).sum()))), a, rows, 5, windows)
            for (w_low, w_high, k), (ids, got) in zip(windows, found):
                ok = counts & (block.ids != 5) & (scores >= w_low) & (scores <= w_high)
                want = sorted(zip(-scores[ok], block.ids[ok]))[:k]
                assert [(-s, i) for s, i in zip(got.tolist(), ids.tolist())] == [tuple(map(int, w)) for w in want]


def clusters_expected(rows, clusters=16, rounds=3):
    kept = [(i, floors(v, 64)) for i, v, _ in rows if v is not None and len(v) == 64 and is_whole(v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, vs in groups.items():
            centres[k] = [sum(x) // len(vs) for x in zip(*vs)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {k: sum(d for _, c, d in placed if c == k) for k in range(clusters)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, k, d in placed]


@pytest.mark.parametrize("n", [420, 5])
def test_centroid_clusters(spark, n):
    rows = odd_vectors() if n == 420 else odd_vectors()[:n]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({"cluster": F.lit(1), "v": F.lit("x"), "n": F.lit(2)})
    got = centroids.centroid_clusters(df)
    assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(clusters_expected(rows), key=str)


def test_ptolemaic_bounds_are_below_and_save_distances():
    rng = np.random.default_rng(6)
    middles = rng.integers(-300, 300, (16, 64))
    x = np.concatenate([m + rng.integers(-20, 20, (200, 64)) for m in middles])
    fixed = middles[:8]
    near = centroids.pivot_distances(x, fixed)
    bounds = centroids.lower_bounds(near, centroids.pivot_distances(middles, fixed), centroids.pivot_pairs(fixed))
    true = np.stack([centroids.exact(x, c) for c in middles], 1)
    assert (bounds <= true).all()
    cluster, distance, measured = centroids.nearest(x, near, middles, fixed)
    assert (cluster == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert measured < 0.5 * true.size


def test_no_vectors(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(nothing).count() == centroids.centroid_clusters(nothing).count() == 0
    blank = spark.createDataFrame([(50, None, 1), (1, [], None)], SCHEMA)
    assert negatives.hard_negatives(blank).count() == centroids.centroid_clusters(blank).count() == 0
