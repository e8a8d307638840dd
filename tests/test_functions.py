import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import cross_products
from tablewright.functions.frequencies import distinct_counts, modes, small_value_sets
from tablewright.functions.group_quantiles import group_quantiles
from tablewright.functions.quantiles import exact_quantiles
from tablewright.operators.ordering import carry_last, with_row_id
from tablewright.operators.recommend import heatmap_data

PS = (0.01, 0.25, 0.5, 0.75, 0.99)


def _check(spark, values, limit, sample=10**9):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    got = exact_quantiles(df, {"x": PS}, inside_limit=limit, sample_values=sample)["x"]
    want = pd.Series(values, dtype=float).quantile(list(PS))
    for p in PS:
        assert got[p] == pytest.approx(want[p], rel=1e-12), (p, limit)


@pytest.mark.parametrize("limit, sample", [(5, 10**9), (10_000, 10**9), (50, 100), (10_000, 1)])
def test_quantiles_match_pandas(spark, limit, sample):
    rng = random.Random(1)
    _check(spark, [rng.gauss(0, 100) for _ in range(3001)], limit, sample)


@pytest.mark.parametrize("limit", [3, 40])
def test_quantiles_with_one_value_in_a_third_of_the_rows(spark, limit):
    rng = random.Random(2)
    values = [7.0] * 1000 + [rng.uniform(-50, 50) for _ in range(1000)] + [1e300, -1e300] * 5
    _check(spark, values, limit)


def test_quantiles_edges(spark):
    df = spark.createDataFrame(
        [(1, 4.0, None, 7.0), (2, 1.0, None, 7.0), (3, float("nan"), None, 7.0)],
        "a int, b double, c double, d double",
    )
    got = exact_quantiles(df, {n: (0.5,) for n in "abcd"})
    assert got == {"a": {0.5: 2.0}, "b": {0.5: 2.5}, "c": {0.5: None}, "d": {0.5: 7.0}}


def test_quantiles_many_rows_narrowing(spark):
    df = spark.range(300_000).select(F.expr("cast((id * 7919) % 300000 as double)").alias("x"))
    got = exact_quantiles(df, {"x": PS}, inside_limit=20, sample_values=5000)["x"]
    want = {p: 299_999 * p for p in PS}
    assert all(math.isclose(got[p], want[p], rel_tol=1e-12) for p in PS)


def test_distinct_sets_and_modes(spark):
    df = spark.createDataFrame(
        [("b", 1, -0.0), ("a", 1, 0.0), ("b", 2, 1.5), ("a", 3, None), (None, None, None)],
        "t string, i int, x double",
    )
    counts = {r["column_name"]: r["unique_count"] for r in distinct_counts(df, ["t", "i", "x"]).collect()}
    assert counts == {"t": 2, "i": 3, "x": 2}
    assert small_value_sets(df, ["t", "i"], 2) == {"t": ["a", "b"]}
    assert modes(df, ["t", "i", "x"]) == {"t": "a", "i": 1, "x": 0.0}


def test_long_texts_are_counted_whole(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",)], "t string")
    assert distinct_counts(df, ["t"]).first()["unique_count"] == 2


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_row_ids_are_contiguous_and_ordered(spark, partitions):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k"), F.lit("same").alias("hot"))
    numbered = with_row_id(df.repartition(partitions), ["hot", "k"], partitions=partitions).toPandas()
    assert sorted(numbered["_row_id"]) == list(range(5000))
    assert (numbered.sort_values("_row_id")["k"].values == np.arange(5000)).all()


def test_row_ids_cost_no_shuffle_when_read(spark):
    rows = spark.range(20_000).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS text")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # the rows are larger
    try:
        numbered = with_row_id(rows, ["text"], partitions=4)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert numbered.select("_row_id").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("block", [1, 7, 200, 10_000])
def test_carry_last_matches_pandas(spark, block):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 9) if rng.random() < 0.2 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "_row_id long, x int").repartition(6)
    want = pd.Series([x for _, x in rows], dtype=float)
    got = carry_last(df, {"y": F.col("x")}, before={"z": F.col("x")}, block_rows=block)
    got = got.toPandas().sort_values("_row_id")
    at, before = got["y"], got["z"]
    pd.testing.assert_series_equal(at.astype(float).reset_index(drop=True), want.ffill(), check_names=False)
    pd.testing.assert_series_equal(
        before.astype(float).reset_index(drop=True), want.ffill().shift(), check_names=False
    )


@pytest.mark.parametrize("partitions", [1, 150])
def test_correlations_of_all_pairs_match_pandas(spark, partitions, monkeypatch):
    """Gaps pair by pair, far-off means, constants, a column without values."""
    monkeypatch.setattr(cross_products, "FAN", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    x[:, 1] = 1e9 + x[:, 0] * 3 + x[:, 1]
    x[rng.random((600, 6)) < 0.3] = np.nan
    frame = pd.DataFrame(np.column_stack([x, np.full(600, 0.1), np.full(600, np.nan)]), columns=[f"c.{i}" for i in range(8)])
    df = spark.createDataFrame(frame).replace(float("nan"), None).repartition(partitions)
    got = {(r.i, r.j): (r.n, r.correlation) for r in cross_products.correlations_of(df, df.columns).collect()}
    expected = frame.corr().to_numpy()
    assert len(got) == 28
    for (i, j), (n, r) in got.items():
        assert n == int((frame.iloc[:, i].notna() & frame.iloc[:, j].notna()).sum())
        assert r is None if max(i, j) > 5 else abs(r - expected[i, j]) < 1e-6


def test_correlations_need_one_scan(spark, tmp_path):
    df = spark.range(50).selectExpr(*[f"(id * {i + 3}) % 17 + 0.5 AS c{i}" for i in range(60)])
    df.write.parquet(str(tmp_path / "wide"))
    plan = heatmap_data(spark.read.parquet(str(tmp_path / "wide")), df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert heatmap_data(df, df.columns).count() == 60 * 59 // 2
    assert [r.correlation for r in heatmap_data(df.limit(0), ["c0", "c1"]).collect()] == [None]


@pytest.mark.parametrize("partitions", [1, 7])
def test_quantiles_of_groups_match_pandas(spark, partitions):
    """A group with two thirds of the rows over many ranges, frequent values, groups of one value."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else rng.choice(["a", "b", "ü", None])
        x = rng.choice([0.0, -0.0, 1.5]) if i % 5 == 0 else rng.gauss(0, 9)
        rows.append((group, None if i % 11 == 0 else x, float("nan") if i % 13 == 0 else float(i % 7)))
    rows += [("one", 4.0, None), ("none", None, None)]
    frame = pd.DataFrame(rows, columns=["g.1", "x", "y"])
    df = spark.createDataFrame(rows, "`g.1` string, x double, y double").repartition(partitions)
    got = {(r.segment, r.column_name): (r.n, r.quantiles) for r in group_quantiles(df, "g.1", ["x", "y"], PS).collect()}
    expected = 0
    for group, part in frame.groupby("g.1"):
        for c in ("x", "y"):
            values = part[c].dropna()
            if len(values):
                expected += 1
                assert got[group, c] == (len(values), pytest.approx(values.quantile(list(PS)).tolist(), rel=1e-12, abs=1e-12))
    assert len(got) == expected
    assert group_quantiles(df.limit(0), "g.1", ["x"], PS).count() == 0
