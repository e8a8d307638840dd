"""Stored profiles: merged parts against the whole table."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import stored_profile as sp
from tablewright.operators.profile import column_profile


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # a third of all rows lies on one day, some have none
    return [
        (
            rng.choice([0, 0, 1, 2, 3, None]), i, rng.choice([None, float("nan"), 0.0, -0.0, rng.gauss(0, 50), rng.gauss(0, 50)]),
            rng.choice(["", "a", "b", None]), rng.random() < 0.5, f"t{i % 3000}",
        )
        for i in range(12_000)
    ]


SCHEMA = "day int, i bigint, x double, s string, b boolean, `many texts` string"


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(9).cache()


def test_merged_days_equal_the_whole_profile(spark, table, tmp_path):
    days = sp.profile_parts(table, by=["day"])
    path = str(tmp_path / "parts")
    days.where("day IS NULL OR day < 2").write.parquet(path)
    days.where("day >= 2").write.mode("append").parquet(path)  # the days that came later
    merged = sp.merge_parts(spark.read.parquet(path))
    got = {r["column_name"]: r for r in sp.stored_column_profile(merged).collect()}
    want = {r["column_name"]: r for r in column_profile(table.drop("day")).collect()}
    assert set(got) == set(want)
    for name, w in want.items():
        g = got[name]
        for fact in ("ordinal", "data_type", "missing_count", "is_numeric", "min_value", "max_value"):
            assert g[fact] == w[fact], (name, fact)
        assert g["mean_value"] == (None if w["mean_value"] is None else pytest.approx(w["mean_value"], abs=1e-9))
        assert g["unique_count"] == pytest.approx(w["unique_count"], rel=0.04)
        assert g["unique_ratio"] <= 1.0
    # empty texts count, and 0.0 and -0.0 are one value
    assert got["s"]["unique_count"] == 3 and got["b"]["unique_count"] == 2


def test_rank_error_of_merged_days(spark, table, rows):
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    merged = sp.merge_parts(sp.profile_parts(table, by=["day"]))
    got = sp.stored_quantiles(merged, ps).collect()
    values = {
        "i": sorted(r[1] for r in rows),
        "x": sorted(r[2] for r in rows if r[2] is not None and r[2] == r[2]),
    }
    checked = 0
    for r in got:
        if r["column_name"] in values:
            v = values[r["column_name"]]
            low, high = bisect.bisect_left(v, r["value"]) / len(v), bisect.bisect_right(v, r["value"]) / len(v)
            assert low - 0.01 <= r["p"] <= high + 0.01, r
            checked += 1
    assert checked == 2 * len(ps)


def test_parts_stay_apart_and_merge_in_steps(table):
    days = sp.profile_parts(table.withColumn("half", F.col("i") % 2), by=["day", "half"])
    once = sp.merge_parts(days, ["day"])
    twice = sp.merge_parts(once)
    straight = sp.merge_parts(days)
    facts = ["column_name", "rows", "non_null", "min_value", "max_value"]
    assert sorted(map(str, twice.select(facts).collect())) == sorted(map(str, straight.select(facts).collect()))
    per_day = {(r["day"], r["column_name"]): r["missing_count"] for r in sp.stored_column_profile(once).collect()}
    for r in table.groupBy("day").agg(F.sum(F.col("s").isNull().cast("int")).alias("n")).collect():
        assert per_day[r["day"], "s"] == r["n"]


def test_outlier_bounds_of_parts(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(101)] + [("b", 1.0), ("b", None)], "k string, v double")
    got = {(r["k"], r["method"]): (r["lower"], r["upper"]) for r in sp.stored_outlier_bounds(sp.profile_parts(df, ["k"])).collect()}
    assert got == {("a", "IQR"): (pytest.approx(-50, abs=3), pytest.approx(150, abs=3)),
                   ("a", "Percentiles"): (pytest.approx(1, abs=1), pytest.approx(99, abs=1))}


def test_empty_tables_and_columns(spark):
    empty = spark.createDataFrame([], "k string, `a.b` double, t string")
    assert sp.profile_parts(empty, ["k"]).count() == 0
    whole = sp.profile_parts(empty)
    profile = {r["column_name"]: r for r in sp.stored_column_profile(whole).collect()}
    assert set(profile) == {"k", "a.b", "t"} and profile["a.b"]["unique_count"] == 0
    assert profile["a.b"]["mean_value"] is None and profile["a.b"]["unique_ratio"] == 0.0
    assert sp.stored_quantiles(whole, [0.5]).count() == 0
    assert sp.stored_outlier_bounds(whole).count() == 0
    with pytest.raises(ValueError, match="no columns"):
        sp.profile_parts(empty.select("k"), ["k"])
