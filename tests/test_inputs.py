"""File order, CSV folders, nested columns, usual questions."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import cleaning as c
from tablewright.operators.ordering import with_row_id
from tablewright.operators.outliers import outlier_stats
from tablewright.operators.questions import tag_questions
from tablewright.plans.approved import apply_cleaning
from tablewright.plans.automatic import clean_table
from tablewright.sources import load_csv
from tablewright.sources.readers import TableError, _lines, validate_table
from tablewright.sources.records import open_after


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Rows 0..2999 in three files of different sizes, b the largest."""
    path = tmp_path_factory.mktemp("files")
    for name, low, high in (("a", 0, 10), ("b", 10, 2500), ("c", 2500, 3000)):
        rows = spark.range(low, high).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("gap"))
        rows.coalesce(1).write.parquet(str(path / name))
    return str(path)


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_ids_follow_paths_and_rows(spark, folder, partitions):
    read = spark.read.option("recursiveFileLookup", True).parquet(folder)
    numbered = with_row_id(read, partitions=partitions)
    assert numbered.where("_row_id <> id").isEmpty() and numbered.count() == 3000
    by_key = with_row_id(read, ["k"], partitions=partitions)
    expected = sorted(range(3000), key=lambda i: (i % 7, i))
    assert [r.id for r in by_key.orderBy("_row_id").collect()] == expected
    first = c.drop_duplicates_first(numbered.select("_row_id", "k"), "_row_id").collect()
    assert sorted((r._row_id, r.k) for r in first) == [(i, i) for i in range(7)]
    filled = c.fill_forward(numbered.repartition(partitions), ["gap"], block_rows=97)
    assert filled.where("gap <> id - id % 5").isEmpty()


def test_partition_starts_stay_out_of_the_plan(spark, folder):
    read = spark.read.option("recursiveFileLookup", True).parquet(folder)
    few, many = (len(with_row_id(read.repartition(n))._jdf.queryExecution().analyzed().toString()) for n in (2, 500))
    assert many < few + 1000


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "2.csv").write_text("b,a\ny,2\n")
    with pytest.raises(TableError, match="headers"):
        load_csv(spark, str(tmp_path))


def test_csv_line_breaks_are_decided_for_each_file(spark, tmp_path):
    (tmp_path / "1.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "2.csv").write_text("a,b\n2,z\n")
    assert sorted(map(tuple, load_csv(spark, str(tmp_path)).collect())) == [(1, "x\ny"), (2, "z")]


def _odd_csv(rng, rows):
    """Quoted breaks, doubled quotes, quotes inside plain fields, empty lines, short and long lines."""
    pieces = ["plain", 'in "ch', "", "x" * 40, '"a\nb"', '"say ""hi"",\n\n"', '"\r\nend"', '"""\n"""', '5"', '"done"', '"c, d"', "NA"]
    lines = ["id,note,more"]
    for i in range(rows):
        lines.append(",".join([str(i), rng.choice(pieces), rng.choice(pieces)][: rng.choice([3, 3, 3, 3, 2])]))
        if rng.random() < 0.1:
            lines.append(rng.choice(["", f"{i},a,b,too many"]))
    return "\n".join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_csv_with_line_breaks_is_read_in_splits(spark, tmp_path, split):
    rng = random.Random(split)
    for i, rows in enumerate([300, 40, 0]):
        (tmp_path / f"{i}.csv").write_bytes(_odd_csv(rng, rows).encode())
    (tmp_path / "plain.csv").write_text("id,note,more\n7,x,y\n")
    (tmp_path / "windows.csv").write_bytes(b'id,note,more\r\n8,"x\r\ny",z\r\n9,q,\r\n')
    (tmp_path / "one.csv").write_bytes(b'id,note,more\n10,"' + b"line\n" * 900 + b'",z\n11,q,r\n')
    whole = load_csv(spark, str(tmp_path), infer=False, multi_line=True).collect()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        rows = load_csv(spark, str(tmp_path), infer=False).collect()
        parts = _lines(spark, str(tmp_path / "0.csv")).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert parts > 5 or split > 900

    def key(r):
        return tuple(str(v) for v in r)

    assert sorted(rows, key=key) == sorted(whole, key=key)


def test_open_quotes_at_line_ends(spark):
    lines = ['a', '"a', 'a"', '"a"', '"a""', '"a"b,"', ',"x,', 'x,"y"",z', '","', '""', '"""', "", 'a "b', "," * 5000 + '"' + '""' * 5000]

    def after(line, inside):
        quoted, start, i = inside, not inside, 0  # start: at a field's first character
        while i < len(line):
            if quoted:
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif line[i] == '"':
                    quoted, start = False, False
            elif line[i] == ",":
                start = True
            else:
                quoted, start = start and line[i] == '"', False
            i += 1
        return quoted

    df = spark.createDataFrame([(v,) for v in lines], "value string")
    outside, inside = open_after(F.col("value"))
    got = df.select("value", outside.alias("o"), inside.alias("i")).collect()
    assert [(r.o, r.i) for r in got] == [(after(r.value, False), after(r.value, True)) for r in got]


def test_wide_tables_are_fine_unless_limited(spark):
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(1200)])
    assert len(validate_table(wide).columns) == 1200
    with pytest.raises(TableError):
        validate_table(wide, max_columns=1000)


def test_nested_columns_pass_through(spark):
    sql = """SELECT * FROM VALUES
      (1, map('a', 1), array(1, 2), struct(1 AS x), INTERVAL '1' DAY, 'p', 2.0D),
      (1, map('a', 1), array(1, 2), struct(1 AS x), INTERVAL '1' DAY, 'p', 2.0D),
      (2, NULL, NULL, NULL, NULL, NULL, NULL) AS t(id, m, a, s, i, t, n)"""
    df = spark.sql(sql)
    assert c.drop_duplicates_first(df).count() == 2
    filled = c.fill_mode(df).where("id = 2").first()
    assert (filled.m, filled.a, filled.s, filled.i, filled.t) == (None, None, None, None, "p")
    row = clean_table(df.withColumn("_row_id", F.monotonically_increasing_id()), "_row_id").table.where("id = 2").first()
    assert (row.m, row.a, row.s, row.i, row.t, row.n) == (None, None, None, None, "p", 2.0)
    actions = {n: "mode" for n in ("m", "a", "s", "i", "t")} | {"n": "median"}
    done = apply_cleaning(df, {"remove_duplicates": True, "missing_actions": actions}).table
    row = done.where("id = 2").first()
    assert done.count() == 2 and (row.m, row.a, row.i, row.t, row.n) == (None, None, None, "p", 2.0)


def test_one_method_asks_for_its_own_facts(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert outlier_stats(df, ["x"], methods=["Z-Score"])["x"].median is None
    assert outlier_stats(df, ["x"], methods=["IQR"])["x"].q3 == 74.25


QUESTIONS = [
    ("Total Sales", "aggregation", "sum", "sales_amount", None),
    ("Show the top 5 Customers", "top_n", "sum", "sales_amount", "category"),
    ("Average Revenue", "aggregation", "mean", "sales_amount", None),
    ("Highest Profit", "aggregation", "max", "profit", None),
    ("Monthly Trend", "diagnostic", None, "sales_amount", "order_date"),
    ("Sales by Category", "group_by", None, "sales_amount", "category"),
    ("Missing Values", "missing_values", None, None, None),
    ("Data Quality Score", "quality_score", None, None, None),
    ("hello", "unknown", None, None, None),
]


def test_usual_questions(spark):
    df = spark.createDataFrame([(q,) for q, *_ in QUESTIONS], "q string")
    tagged = tag_questions(df, "q", numeric=["sales_amount", "quantity", "profit"], categorical=["category", "region"], temporal=["order_date"])
    got = {r.q: (r.question_type, r.operation, r.group_col) for r in tagged.collect()}
    assert got == {q: (kind, op, group) for q, kind, op, _, group in QUESTIONS}
