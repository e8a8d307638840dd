"""Edge tables and properties of profiling and cleaning."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright import sources as src
from tablewright.functions.storage import scratch_path
from tablewright.functions.text import snake_case_labels
from tablewright.operators import cleaning as c
from tablewright.operators import outliers
from tablewright.operators import profile as p
from tablewright.operators import treatments as t
from tablewright.operators.cleaning import interpolate
from tablewright.operators.missing import missing_association
from tablewright.operators.ordering import with_row_id
from tablewright.plans.approved import apply_cleaning
from tablewright.plans.automatic import clean_table, cleaning_advice

EDGE = """SELECT * FROM (VALUES (1, 5.0, 'b', CAST(NULL AS DOUBLE), 7.0), (2, 1.0, 'a', NULL, 7.0), (3, 3.0, 'b', NULL, 7.0),
  (4, NULL, 'a', NULL, 7.0), (5, 9.0, NULL, NULL, 7.0)) AS t(row_id, v, k, all_null, constant)"""


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    return df.first().asDict()


def test_median_of_an_even_count_and_mode_ties(spark):
    edge = spark.sql(EDGE)
    filled = c.fill_mode(c.fill_median(edge), ["k"]).orderBy("row_id").collect()
    assert [r["v"] for r in filled] == [5.0, 1.0, 3.0, 4.0, 9.0]
    assert [r["k"] for r in filled] == ["b", "a", "b", "a", "a"]
    assert all(r["all_null"] is None and r["constant"] == 7 for r in filled)


def test_mode_of_an_empty_text_column_is_empty_text(spark):
    df = spark.createDataFrame([(None,), (None,)], "t string")
    assert rows(c.fill_mode(df)) == [("",), ("",)]


def test_profile_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "a")], "x double, t string")
    profile = {r["column_name"]: r for r in p.column_profile(df).collect()}
    assert profile["x"]["missing_count"] == 2 and profile["x"]["unique_count"] == 1
    assert profile["t"]["unique_ratio"] == 0.5
    assert one(p.table_stats(df))["missing_values"] == 3


def test_infinite_statistics_are_left_out(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,)], "x double")
    assert one(p.numeric_stats(df)) == {"column_name": "x", "min_value": 1.0, "max_value": None, "mean_value": None}


def test_preview_writes_numbers_plainly(spark):
    numbers = [112946260.0, 0.5, 12345678.125, 0.00025, -98765432.1, 3.0, 1234567890123456.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)] + [(99, None)], "n int, x double")
    assert [r["x"] for r in p.preview(df, ["n"]).collect()] == [str(x) for x in numbers] + [None]


def test_indicator_without_any_value(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "x double, k int")
    table = apply_cleaning(df, {"missing_actions": {"x": "indicator"}}).table
    assert sorted(rows(table)) == [(None, 1, 1), (None, 2, 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    stats = one(p.table_stats(df))
    assert stats["row_count"] == 0 and stats["missing_percent"] == 0.0
    assert one(p.quality_score(df))["quality_score"] == 100
    assert [r["issue"] for r in p.issues(df).collect()] == ["healthy"]
    assert one(p.completeness_score(df)) == {"completeness_score": 0.0}
    with pytest.raises(src.TableError):
        src.validate_table(df)


def test_duplicates_treat_nulls_as_equal_and_minus_zero_as_zero(spark):
    df = spark.createDataFrame(
        [(None, 0.0, "x" * 100), (None, -0.0, "x" * 100), (1, 0.0, None), (1, 0.0, None), (None, 0.0, None)],
        "a int, b double, t string",
    )
    assert one(p.duplicate_count(df)) == {"duplicate_rows": 2}
    wide = df.select("*", *[F.lit(i).alias(f"c{i}") for i in range(30)])
    assert one(p.duplicate_count(wide)) == {"duplicate_rows": 2}
    assert c.drop_duplicates_first(df).count() == 3


def test_first_copy_is_kept(spark):
    df = spark.createDataFrame([(i, "same") for i in range(50)] + [(50, "other")], "_row_id long, t string")
    kept = c.drop_duplicates_first(df.repartition(7), "_row_id")
    assert sorted(rows(kept)) == [(0, "same"), (50, "other")]


def test_score_rounds_half_to_even(spark):
    # 100 - 2 * 3.75 = 92.5 -> 92
    cells = [(None if i < 3 else 1, 1) for i in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(cells)], "n int, a int, b int").drop("n")
    found = one(p.quality_score(df))
    assert found["missing_percent"] == 3.75 and found["duplicate_rows"] > 0
    assert found["quality_score"] == 88  # 87.5 after the duplicate penalty
    unique = spark.createDataFrame([(i, *r) for i, r in enumerate(cells)], "n int, a int, b int")
    assert one(p.quality_score(unique))["quality_score"] == 95


def test_label_clashes_get_numbers():
    assert snake_case_labels(["A b", "a_b", " OrderID ", "HTTPServer2Go", "x--y"]) == [
        "a_b", "a_b_2", "order_id", "http_server2_go", "x_y",
    ]


def test_labels_with_dots_and_quotes_work(spark):
    df = spark.createDataFrame([(1, "a"), (None, "it's")], "`a.b` int, `it's` string")
    assert {r["column_name"] for r in p.column_profile(df).collect()} == {"a.b", "it's"}
    assert [r["column_name"] for r in p.missing_by_column(df).collect()] == ["a.b"]
    assert c.snake_case_columns(df).columns == ["a_b", "it_s"]


def test_numbers_in_text(spark):
    good = ["1", " 12 ", "1e5", "-.5", "inf", "+3.", "0012", "7", "8", "9", "10", "11", "12", "13", "14"]
    df = spark.createDataFrame([(x,) for x in good + ["1d"]], "t string")
    found = [r["t"] for r in c.coerce_numeric(df).collect()]
    assert found[1] == 12.0 and found[-1] is None and found[3] == -0.5
    bad = spark.createDataFrame([(x,) for x in ["1,000", "0x1A", "True", "1_000", "1f"]], "t string")
    assert c.coerce_numeric(bad).schema["t"].dataType.simpleString() == "string"


def test_whole_numbers_stay_whole_without_gaps(spark):
    df = spark.createDataFrame([("1",), ("2",)], "t string")
    assert c.coerce_numeric(df).schema["t"].dataType.simpleString() == "bigint"
    df = spark.createDataFrame([("1",), (None,)], "t string")
    assert c.coerce_numeric(df).schema["t"].dataType.simpleString() == "double"


def test_first_value_sets_the_date_format(spark):
    values = ["01/05/2024", "13/05/2024", "2024-05-01", "12/31/2024"]
    df = spark.createDataFrame(list(enumerate(values)), "_row_id long, day_date string")
    found = [r["day_date"] for r in c.parse_dates(df).orderBy("_row_id").collect()]
    assert found == [dt.datetime(2024, 1, 5), None, None, dt.datetime(2024, 12, 31)]


def test_date_named_numbers_are_nanoseconds(spark):
    df = spark.createDataFrame([(0, 1_700_000_000_000_000_000)], "_row_id long, event_time long")
    assert c.parse_dates(df).first()["event_time"] == dt.datetime(2023, 11, 14, 22, 13, 20)


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_cleaning_does_not_depend_on_partitions(spark, partitions):
    data = [(i, f"2024-01-{i % 28 + 1:02d}" if i % 3 else None, i % 5 or None, "  a  b " if i % 4 else None, 2 * i) for i in range(300)]
    schema = "_row_id long, DayDate string, Amount int, t string, uniqueKey int"
    df = spark.createDataFrame(data, schema).repartition(partitions)
    result = clean_table(df, "_row_id")
    again = clean_table(result.table, "_row_id")
    first, second = sorted(rows(result.table)), sorted(rows(again.table))
    assert first == second and len(first) == 300
    values, last = [row[1] for row in data], None
    head = next(v for v in values if v)
    for (_, day, amount, text, _), raw in zip(first, values):
        last = raw or last
        assert day == dt.datetime.fromisoformat(last or head)
        assert amount is not None and text == "a b"
    metrics = one(result.metrics)
    assert 0 <= metrics["quality_before"] <= metrics["quality_after"] <= 100
    assert metrics["missing_filled"] == 100 + 60 + 75


def test_bad_values_stay_missing_in_columns_without_gaps(spark):
    data = [(i, "oops" if i == 3 else str(i)) for i in range(40)]
    result = clean_table(spark.createDataFrame(data, "_row_id long, points string"), "_row_id")
    assert result.table.where("points IS NULL").count() == 1
    assert one(result.metrics)["missing_filled"] == 0


def test_advice_for_a_clean_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "a int, b string")
    assert rows(cleaning_advice(df)) == [(0, "nothing to clean", None, 0)]


def test_null_rows_survive_outlier_treatment(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 1000]] + [(None,)], "x double")
    assert sorted(rows(t.treat_outliers(df, "x", "remove")), key=str) == [(1.0,), (2.0,), (3.0,), (4.0,), (None,)]
    capped = [r["x"] for r in t.treat_outliers(df, "x", "cap").collect()]
    assert capped.count(None) == 1 and max(x for x in capped if x is not None) == 7.0
    assert rows(t.treat_outliers(df, "x", "nullify")).count((None,)) == 2
    assert t.treat_outliers(df, "x", "keep").count() == 6


def test_removals_change_the_next_column(spark):
    data = [(float(i % 10), float(i % 7)) for i in range(100)] + [(1000.0, 500.0), (1.0, 90.0)]
    df = spark.createDataFrame(data, "a double, b double")
    result = apply_cleaning(df, {"outlier_actions": {"a": "remove", "b": "remove"}})
    assert [r["rows_affected"] for r in result.audit.where("status = 'APPROVED'").collect()] == [1, 1]
    assert result.table.count() == 100


def test_audit_names_skipped_steps(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, "a")], "x double, t string")
    audit = apply_cleaning(
        df, {"remove_duplicates": True, "missing_actions": {"t": "skip", "gone": "median"}}
    ).audit.collect()
    assert [(r["action"], r["status"]) for r in audit] == [
        ("drop_duplicates", "DECLINED/SKIPPED"),
        ("drop_empty_rows", "DECLINED/SKIPPED"),
        ("skip", "DECLINED/SKIPPED"),
    ]


def test_indicator_on_text_and_numbers(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None), (None, "a")], "x double, t string")
    table = apply_cleaning(df, {"missing_actions": {"x": "indicator", "t": "indicator"}}).table
    assert table.columns == ["x", "t", "x_missing", "t_missing"]
    assert sorted(rows(table)) == [(1.0, "a", 0, 0), (2.0, "a", 1, 0), (3.0, "a", 0, 1)]


def test_forward_fill_in_file_order_or_by_column(spark):
    df = spark.createDataFrame([(3, None), (1, "a"), (2, None), (0, None)], "k int, t string")
    table = apply_cleaning(df, {"missing_actions": {"t": "ffill"}}, order_by=["k"]).table
    assert sorted((r["k"], r["t"]) for r in table.collect()) == [(0, "a"), (1, "a"), (2, "a"), (3, "a")]


def test_csv_with_line_breaks_long_and_short_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,"x, ""y""\nz",2.5\n2,short\n3,p,q,too long\n4,NA,\n5,"  ",7\n')
    df = src.load_csv(spark, str(path))
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert sorted(rows(df), key=str) == [(1, 'x, "y"\nz', 2.5), (2, "short", None), (4, None, None), (5, None, 7.0)]


def test_written_table_keeps_order_and_escapes(spark):
    path = scratch_path(spark, "t")
    df = with_row_id(spark.createDataFrame([(2, "=x"), (1, " y ")], "k int, t string"), ["k"])
    src.write_clean(df, path, row_id="_row_id")
    assert [tuple(r) for r in src.load_csv(spark, path).orderBy("k").collect()] == [(1, " y "), (2, "'=x")]


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_interpolation_matches_pandas(spark, partitions):
    """Long and short gaps, a block without values, gaps at both ends."""
    rng = random.Random(1)
    values = [None if i < 3 or i > 480 or 100 <= i < 230 or rng.random() < 0.4 else rng.uniform(-50, 50) for i in range(500)]
    whole = [None if i % 3 else i * i for i in range(500)]
    times = [i * 10.0 + rng.randrange(9) for i in range(500)]
    df = spark.createDataFrame(list(zip(range(500), values, whole, times)), "id long, x double, n int, t double")
    df = df.repartition(partitions)
    frame = pd.DataFrame({"x": pd.array(values, "float64"), "n": pd.array(whole, "float64")})
    for by, index, method in ((None, range(500), "linear"), ("t", times, "index")):
        expected = frame.set_index(pd.Index(index)).interpolate(method=method, limit_direction="both")
        inner = frame.set_index(pd.Index(index)).interpolate(method=method, limit_area="inside")
        for edges, want in ((True, expected), (False, inner)):
            out = interpolate(df, ["x", "n"], "id", by=by, edges=edges, block_rows=40).orderBy("id").toPandas()
            assert np.allclose(out[["x", "n"]].to_numpy(float), want.to_numpy(), equal_nan=True)
            assert out.columns.tolist() == ["id", "x", "n", "t"]


def test_interpolation_without_places_or_values(spark):
    rows = [(0, 1.0, 0.0), (1, None, None), (2, None, 4.0), (3, 5.0, 4.0), (4, None, 4.0), (5, 9.0, 4.0), (6, 7.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, t double")
    out = [r.x for r in interpolate(df, ["x"], "id", by="t").orderBy("id").collect()]
    assert out == [1.0, None, 5.0, 5.0, 5.0, 9.0, 7.0]
    blank = spark.createDataFrame([(0, None), (1, None)], "id long, x double")
    assert [r.x for r in interpolate(blank, ["x"], "id").collect()] == [None, None]
    assert interpolate(blank.limit(0), ["x"], "id").count() == 0


def test_approved_interpolation(spark):
    df = spark.createDataFrame([(0, 1.0, None, "a"), (1, None, None, None), (2, 4.0, None, "b")], "id long, x double, y double, s string")
    config = {"missing_actions": {"x": "interpolate", "y": "interpolate", "s": "interpolate"}}
    result = apply_cleaning(df, config, "id")
    assert [tuple(r) for r in result.table.orderBy("id").collect()] == [(0, 1.0, None, "a"), (1, 2.5, None, None), (2, 4.0, None, "b")]
    assert [(r.column_name, r.status[:8], r.rows_affected) for r in result.audit.where("column_name IS NOT NULL").collect()] == [("x", "APPROVED", 1), ("y", "DECLINED", 0), ("s", "DECLINED", 0)]


def test_outliers_within_their_segment(spark):
    """100 is usual in one segment and far out in the other; rows without a segment stay."""
    rows = [(i, "low", float(i)) for i in range(20)] + [(20 + i, "high", 90.0 + i) for i in range(20)]
    rows += [(40, "low", 100.0), (41, "high", 1.0), (42, None, 1e6), (43, "few", 1e6), (44, "low", None)]
    df = spark.createDataFrame(rows, "id long, s string, x double")
    flagged = outliers.segment_outliers(df, "s", "id", ["x"]).collect()
    assert sorted((r.row_id, r.segment) for r in flagged) == [(40, "low"), (41, "high")]
    result = apply_cleaning(df, {"outlier_actions": {"x": ("nullify", "s")}}, "id")
    assert {r.id for r in result.table.where("x IS NULL").collect()} == {40, 41, 44}
    assert [(r.action, r.rows_affected) for r in result.audit.where("column_name = 'x'").collect()] == [("nullify by s", 2)]
    kept = apply_cleaning(df, {"outlier_actions": {"x": ("remove", "s")}}, "id").table
    assert kept.count() == 43 and kept.where("id IN (42, 43, 44)").count() == 3
    again = apply_cleaning(df, {"outlier_actions": {"x": ("remove", "nowhere"), "id": "keep"}}, "id")
    assert again.table.count() == 45 and again.audit.where("status <> 'APPROVED' AND column_name = 'x'").count() == 1
    summary = {(r.segment): r.outlier_count for r in outliers.segment_outlier_summary(df, "s", ["x"]).collect()}
    assert summary == {"low": 1, "high": 1}
    assert outliers.segment_outlier_summary(df.limit(0), "s", ["x"]).count() == 0


def test_rescale_and_flag(spark):
    values = [10.0, 11.0, 12.0, 13.0, 14.0, None, 1100.0, 12500.0, 500.0, -1200.0]
    df = spark.createDataFrame([(i, v, "s") for i, v in enumerate(values * 3)], "id int, x double, x_outlier string")
    # More plain values, so that the bounds stay narrow.
    df = df.union(spark.range(200).selectExpr("cast(id + 100 as int)", "10.0D + id % 5", "'s'"))
    scaled = {r.id: r.x for r in t.treat_outliers(df, "x", "rescale").collect()}
    assert [scaled[i] for i in range(10)] == [10.0, 11.0, 12.0, 13.0, 14.0, None, 11.0, 12.5, 500.0, -1200.0]
    flagged = t.treat_outliers(df, "x", "flag")
    assert flagged.columns == ["id", "x", "x_outlier", "x_outlier_"] and flagged.count() == df.count()
    assert {r.id: r.x_outlier_ for r in flagged.where("id < 10").collect()} == {i: int(i > 5) for i in range(10)}
    empty = df.limit(0)
    assert t.treat_outliers(empty, "x", "rescale").count() == 0 and t.treat_outliers(empty, "x", "flag").count() == 0
    negative = df.selectExpr("id", "-x AS x")  # no unit explains values against a median below 0
    assert t.treat_outliers(negative, "x", "rescale").exceptAll(negative).isEmpty()
    by = t.treat_by_segment(df.drop("x_outlier").withColumn("s", F.lit("a")), "x", "flag", "s")
    assert {r.id: r.x_outlier for r in by.where("id < 10").collect()} == {i: int(i > 5) for i in range(10)}


def test_missing_association_without_anything_to_compare(spark):
    df = spark.createDataFrame([("a", "x", None, 1), ("b", "x", None, None), (None, "x", None, 2)], "g string, one string, none int, some int")
    rows = {(r.column_name, r.segment_column): r for r in missing_association(df).collect()}
    assert rows["some", "g"].cramers_v == 1.0 and rows["some", "g"].rows == 2
    assert rows["some", "one"].cramers_v is None and rows["none", "g"].cramers_v is None
    assert missing_association(df.limit(0)).count() == 0
