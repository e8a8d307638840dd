"""Missing values, outliers, roles, diagnosis and questions on small tables."""

import random

import pandas as pd
import pytest

from tablewright.operators import diagnosis as d
from tablewright.operators import missing as m
from tablewright.operators import outliers as o
from tablewright.operators import recommend as r
from tablewright.operators.answers import chart_data
from tablewright.operators.ask import aggregate, bottom_n, chart_series, top_n
from tablewright.operators.questions import tag_questions
from tablewright.operators.roles import infer_roles
from tablewright.operators.story import data_insights, half_trend, peak_trough_month


def rows(df):
    return [tuple(x) for x in df.collect()]


@pytest.mark.parametrize("block", [1, 13, 5000])
@pytest.mark.parametrize("partitions", [1, 7])
def test_longest_run_matches_pandas(spark, block, partitions):
    rng = random.Random(block)
    data = [(i, None if rng.random() < 0.6 else 1, None if 300 <= i < 700 else 2) for i in range(1000)]
    df = spark.createDataFrame(data, "_row_id long, a int, b int").repartition(partitions)
    got = {x["column_name"]: x["longest_run"] for x in m.longest_null_run(df, block_rows=block).collect()}
    gap = pd.Series([a is None for _, a, _ in data]).astype(int)
    want = int((gap.groupby((gap != gap.shift()).cumsum()).transform("sum") * gap).max())
    assert got == {"a": want, "b": 400}


def test_longest_run_with_repeated_and_missing_ids(spark):
    data = [(i, None if 20 <= i < 30 or i == 50 else 1, None) for i in [*range(-5, 60), *range(15, 30)]]
    data += [(None, None, None)] * 40
    wide = ", ".join(f"x{i} int" for i in range(70))
    df = spark.createDataFrame([(*r, *[None if r[0] in (3, 4, i) else i for i in range(70)]) for r in data], f"_row_id long, a int, b int, {wide}")
    for block in (1, 7, 5000):
        got = {x["column_name"]: x["longest_run"] for x in m.longest_null_run(df.repartition(3), block_rows=block).collect()}
        want = {f"x{i}": 3 if i in (2, 5) else 2 for i in range(70)}
        assert got == {"a": 20, "b": 80, **want}


def test_runs_shuffle_ids_and_bits_only(spark):
    data = [(i, None if i % 3 else i, None if i % 5 else i) for i in range(100)]
    df = spark.createDataFrame(data, "_row_id long, a long, b long")
    plan = m.longest_null_run(df, columns=["a", "b"], block_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan  # no row per missing cell
    assert plan.count("Exchange") == 2  # rows by block, and a row per block and column


def test_a_column_without_values_is_one_run_and_all_tail(spark):
    df = spark.createDataFrame([(i, None) for i in range(20)], "_row_id long, a int")
    features = m.missing_features(df).first()
    assert features["longest_run"] == 20 and features["missing_tail_only"] and features["missing_percent"] == 100.0
    causes = [x["cause"][6] for x in m.missing_causes(m.missing_features(df)).orderBy("cause_order").collect()]
    assert causes == ["I", "B", "F"]


def test_no_gaps_no_rows(spark):
    df = spark.createDataFrame([(0, 1), (1, 2)], "_row_id long, a int")
    assert m.missing_features(df).count() == 0
    assert m.missing_by_segment(df).count() == 0


def test_flat_and_short_columns_have_no_outliers(spark):
    df = spark.createDataFrame([(i, 7.0, 1.0 if i < 4 else None) for i in range(30)], "_row_id long, flat double, few double")
    stats = o.outlier_stats(df)
    assert list(stats) == ["flat"] and o.outlier_summary(df, stats=stats).count() == 0
    assert o.outlier_votes(df).count() == 0


def test_votes_match_pandas(spark):
    rng = random.Random(5)
    data = [(i, rng.gauss(100, 10) if i % 50 else 900.0) for i in range(500)]
    df = spark.createDataFrame(data, "_row_id long, amount double").repartition(6)
    x = pd.Series([v for _, v in data])
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    z = ((x - x.mean()) / x.std()).abs() > 3
    mad = (x - x.median()).abs().median()
    flags = {
        "IQR": (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)),
        "Z-Score": z,
        "Modified Z-Score": (0.6745 * (x - x.median()) / mad).abs() > 3.5,
        "Percentiles": (x < x.quantile(0.01)) | (x > x.quantile(0.99)),
    }
    table = pd.DataFrame(flags)
    expected = [
        (int(i), ", ".join(n for n in flags if table.loc[i, n])) for i in table.index[table.any(axis=1)]
    ]
    got = [(x["_row_id"], x["methods"]) for x in o.outlier_votes(df, sample=1000).orderBy("_row_id").collect()]
    assert got == expected
    assert len(o.outlier_votes(df).collect()) == min(15, len(expected))


def test_roles(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", "Y", 1.5, None, "x", 2020, 1.0), (2, "soon", "n", 2.5, None, "y", 2021, 0.0), (3, None, "y", 0.5, None, "z", 2022, 1.0)],
        "order_id int, due_date string, paid string, unit_num double, empty string, zip_code string, year int, bit double",
    )
    assert infer_roles(df) == {
        "order_id": "Identifier", "due_date": "Date/Time", "paid": "Identifier", "unit_num": "Numerical",
        "empty": "Boolean", "zip_code": "Identifier", "year": "Date/Time", "bit": "Numerical",
    }


def test_every_chart_has_data(spark):
    data = [(i, f"k{i % 3}", f"g{i % 2}", f"2024-0{i % 6 + 1}-01", i * 1.25, (i * 7 % 50) + 0.5, (i * i % 90) + 0.25) for i in range(120)]
    df = spark.createDataFrame(data, "_row_id long, kind string, grade string, day string, price double, cost double, weight double")
    df = df.withColumn("day", df["day"].cast("date"))
    charts = [("Line Chart", "day", "price"), ("Bar Chart", "kind", "price"), ("Bar Chart", "kind", "Record Count"), ("Pie Chart", "kind", "Count"),
              ("Scatter Plot", "price", "cost"), ("Geographic Map", "kind", "price"), ("Stacked Bar Chart", "kind", "price by grade"),
              ("Histogram", "price", "Frequency")]
    for chart, x, y in charts:
        assert chart_data(df, chart, x, y, "_row_id").count() > 0, chart
    for frame, row_id in ((df, "_row_id"), (df.drop("_row_id"), None)):
        got = chart_data(frame, "Heatmap", "Numerical Columns Matrix", "Correlation Score", row_id).collect()
        assert [(x.x, x.y) for x in got] == [("price", "cost"), ("price", "weight"), ("cost", "weight")]
        assert all(abs(x.correlation - df.stat.corr(x.x, x.y)) < 1e-9 for x in got)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 7.0, float(-2 * i)) for i in range(10)], "a double, b double, c double")
    assert rows(d.top_correlation(df, "a")) == [("c", pytest.approx(-1.0), "strong", "negative")]
    pairs = {(x["x"], x["y"]): x["correlation"] for x in r.heatmap_data(df, ["a", "b", "c"]).collect()}
    assert pairs["a", "b"] is None and pairs["a", "c"] == pytest.approx(-1.0)


def test_histogram_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert sum(x["frequency"] for x in r.histogram_data(df, "x", 4).collect()) == 2
    assert r.histogram_data(df.limit(0), "x").count() == 0


def test_empty_sum_is_zero_and_ranks_break_ties_by_group(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 5.0), (None, 9.0), ("d", None)], "g string, x double")
    assert rows(aggregate(df.limit(0), "x")) == [(0.0,)]
    assert rows(aggregate(df, "x", "count")) == [(4,)]
    assert rows(top_n(df, "g", "x", 2)) == [("c", 5.0), ("a", 1.0)]
    assert rows(bottom_n(df, "g", "x", 2)) == [("d", 0.0), ("a", 1.0)]
    pie = rows(chart_series(df, "g", "x", chart="pie", sort="desc"))
    assert pie[0] == ("c", 5.0, pytest.approx(500 / 7))


def test_trend_needs_two_months_and_survives_zero(spark):
    one = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-05' AS d, 1.0D AS x")
    assert d.monthly_trend(one, "d", "x").count() == 0 and half_trend(one, "d", "x").count() == 0
    assert peak_trough_month(one, "d", "x").count() == 0
    two = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-05', 0.0D), (TIMESTAMP_NTZ'2024-02-05', 4.0D) t(d, x)")
    trend = d.monthly_trend(two, "d", "x").first()
    assert trend["change_percent"] == 0.0 and trend["best_month"] == "2024-02" and trend["direction"] == "decreased"
    assert half_trend(two, "d", "x").first()["trend"] == "up"


def test_insights_skip_what_is_not_there(spark):
    df = spark.createDataFrame([("a", -1.0), ("b", -2.0), ("a", -3.0)], "seg string, sales double")
    assert [(x["kind"], x["label"], x["share"]) for x in data_insights(df).collect()] == [("best segment", "b", None)]


def test_suggested_questions(spark):
    asked = [
        "Total Sales", "Top 5 Customers", "Average Revenue", "Highest Profit", "Monthly Trend", "Sales by Category",
        "Missing Values", "Data Quality Score", "top 0 sales", "group the sales",
    ]
    df = spark.createDataFrame(list(enumerate(asked)), "n int, q string")
    got = tag_questions(df, "q", ["sales", "profit"], ["category"], ["order_date"]).orderBy("n").collect()
    assert [(x["question_type"], x["operation"], x["target_col"], x["group_col"]) for x in got] == [
        ("aggregation", "sum", "sales", None),
        ("top_n", "sum", "sales", "category"),
        ("aggregation", "mean", "sales", None),
        ("aggregation", "max", "profit", None),
        ("diagnostic", None, "sales", "order_date"),
        ("group_by", None, "sales", "category"),
        ("missing_values", None, "sales", None),
        ("quality_score", None, None, None),
        ("aggregation", "sum", "sales", None),
        ("diagnostic", None, "sales", None),
    ]


def test_long_follow_up_chain_in_one_conversation(spark):
    turns = [(0, "Sales by region")] + [(i, "what about the average") for i in range(1, 400)]
    other = [(0, "what about profit"), (1, "how about each region"), (2, "and the total")]
    data = [(1, t, q) for t, q in turns] + [(2, t, q) for t, q in other]
    df = spark.createDataFrame(data, "c int, t int, q string").repartition(5)
    got = tag_questions(df, "q", ["sales", "profit"], ["category", "region"], conversation="c", turn="t")
    found = {(x["c"], x["t"]): x["group_col"] for x in got.collect()}
    assert all(found[1, t] == "region" for t in range(400))
    assert [found[2, t] for t in range(3)] == [None, "region", "region"]
