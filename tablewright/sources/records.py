"""CSV records from splits of files whose quoted fields hold line breaks.

Whether a line starts a record depends on all quotes before it. Each line is a function from
"inside a quoted field" at its start to the same at its end; functions of lines compose to
functions of splits, and those give the state at the start of every split. Lines are dealt by
split, so a large file takes as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise

# Whole fields with their commas, then a field that opens and does not close. A quote opens a
# field only as its first character; after the closing quote all up to the comma is text.
# Possessive throughout: no backtracking, however long the line.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
OPEN_AT_END = rf'(?s)\A(?:{_QUOTED}"[^,]*+,|[^",][^,]*+,|,)*+{_QUOTED}\z'


def open_after(line: Column) -> tuple[Column, Column]:
    """Whether a quoted field is open after the line: if none was before, and if one was."""
    plain = ~F.contains(line, F.lit('"'))
    outside = F.when(plain, False).otherwise(line.rlike(OPEN_AT_END))
    inside = F.when(plain, True).otherwise(F.concat(F.lit('"'), line).rlike(OPEN_AT_END))
    return outside, inside


def _running(fixed: Column, turns: Column, window) -> tuple[Column, Column]:
    """Composition of functions over a window: `fixed` is the result of a function that ignores
    its argument (else null), `turns` is 1 for negation. Returns parity of the turns, and the last
    fixed result corrected by the turns before it (null: none)."""
    return F.sum(turns).over(window) % 2, F.last(fixed, ignorenulls=True).over(window)


def records(lines: DataFrame) -> DataFrame:
    """(record) of every record but each file's first, from `lines` (file, block, at, value): the
    file's name, the place of the split in it, and an ascending id of the line within the split.

    Lines are cut at line feeds only; a carriage return before a record's end is removed, and in
    files whose first line ends in one, those before line breaks in quoted fields, too.
    Empty lines outside quoted fields are no records. A record over several splits is joined.
    """
    place = Window.partitionBy("file", "block").orderBy("at")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    outside, inside = open_after(F.col("value"))
    rows = lines.withColumns({"out": outside.cast("int"), "in": inside.cast("int")})
    same, turn = F.expr("out = in"), F.expr("CAST(out = 1 AND in = 0 AS INT)")
    rows = rows.withColumns({"same": same, "turn": turn})
    rows = rows.withColumn("turned", F.sum("turn").over(place.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    rows = rows.withColumn("fixed", F.when(F.col("same"), (F.col("out") + F.col("turned")) % 2))
    parity, fixed = _running(F.col("fixed"), F.col("turn"), before)
    rows = rows.withColumns({"parity": F.coalesce(parity, F.lit(0)), "base": fixed})
    for s in (0, 1):  # state before the line, and the line its record starts with, if the split starts in state s
        rows = rows.withColumn(f"open{s}", (F.coalesce("base", F.lit(s)) + F.col("parity")) % 2)
        start = F.max(F.when(F.col(f"open{s}") == 0, F.col("at"))).over(place)
        rows = rows.withColumn(f"start{s}", start)
    rows = rows.withColumns({f"after{s}": F.expr(f"IF(open{s} = 1, in, out)") for s in (0, 1)})
    kept = ["file", "block", "at", "value", *[f"{n}{s}" for n in ("open", "start", "after") for s in (0, 1)]]
    rows = materialise(rows.select(*kept))

    # One row per split; a file's splits meet in a window, which is short.
    blocks = rows.groupBy("file", "block").agg(
        *[F.max_by(f"after{s}", "at").alias(f"after{s}") for s in (0, 1)],
        *[F.max(f"start{s}").alias(f"start{s}") for s in (0, 1)],
        F.min(F.when(~F.col("value").isin("", "\r"), F.col("at"))).alias("first"),
        F.min_by(F.col("value").endswith("\r"), "at").alias("crlf"),
    )
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("turn", F.expr("CAST(after0 = 1 AND after1 = 0 AS INT)"))
    blocks = blocks.withColumn("turned", F.sum("turn").over(order) % 2)
    blocks = blocks.withColumn("fixed", F.when(F.expr("after0 = after1"), (F.col("after0") + F.col("turned")) % 2))
    parity, fixed = _running(F.col("fixed"), F.col("turn"), earlier)
    blocks = blocks.withColumn("state", (F.coalesce(fixed, F.lit(0)) + F.coalesce(parity, F.lit(0))) % 2)
    blocks = blocks.withColumn("begun", F.expr("IF(state = 1, start1, start0)"))
    all_blocks = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumns({
        "begun": F.last("begun", ignorenulls=True).over(earlier),
        "first": F.first("first", ignorenulls=True).over(all_blocks),
        "crlf": F.first("crlf").over(all_blocks),
    })
    starts = materialise(blocks.select("file", "block", "state", "begun", "first", "crlf"))

    rows = rows.join(starts, ["file", "block"])
    chosen = {n: F.expr(f"IF(state = 1, {n}1, {n}0)") for n in ("open", "start", "after")}
    rows = rows.withColumns(chosen).withColumn("start", F.coalesce("start", "begun"))
    rows = rows.where(F.col("start").isNull() | (F.col("start") != F.col("first")))
    ending = F.when(F.col("crlf"), F.regexp_replace("value", r"\r\z", "")).otherwise(F.col("value"))
    rows = rows.withColumn("value", ending)
    single = (F.col("open") == 0) & (F.col("after") == 0)
    whole = rows.where(single & ~F.col("value").isin("", "\r")).select(F.col("value").alias("record"))
    parts = rows.where(~single).groupBy("file", "start").agg(
        F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("lines")
    )
    joined = parts.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    return whole.union(joined).select(F.regexp_replace("record", r"\r\z", "").alias("record"))
