"""Row order for operators that need it: forward fill, runs, first/last row.

A table gets one contiguous row id. Everything that depends on order then works
on equal blocks of ids, so no task ever holds more than one block, whatever the
order column looks like.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ROW_ID, col, quoted
from ..functions.storage import materialise

BLOCK_ROWS = 1_000_000
MAX_BLOCKS = 20_000
_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, position below
_FILE, _SPLIT, _AT, _PART = "_tw_file", "_tw_split", "_tw_at", "_tw_part"


def with_places(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """`df` with each row's file, split and position, as far as known, and the columns that
    put rows in input order. Spark packs the splits of several files by size, so a running
    number alone is not file order."""
    placed = df.withColumn(_AT, F.monotonically_increasing_id())
    if "_metadata" not in df.columns and _from_files(placed):
        return placed.withColumns(
            {_FILE: F.col("_metadata.file_path"), _SPLIT: F.col("_metadata.file_block_start")}
        ), [_FILE, _SPLIT, _AT]
    return placed, [_AT]


def _from_files(df: DataFrame) -> bool:
    """Whether rows still know the file they were read from."""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    return any(hidden.apply(i).name() == "_metadata" for i in range(hidden.size()))


def with_row_id(
    df: DataFrame,
    order_by: Sequence[str] = (),
    name: str = ROW_ID,
    partitions: int | None = None,
) -> DataFrame:
    """Add row ids 0..n-1 in the order of `order_by`, or in file order without it.

    File order is by path, and in a file from its beginning. A frame that is no longer
    read straight from files (joined, grouped) has the order of its partitions. Ties are
    broken by that order, which also keeps equal order values from landing in one range.
    The placed rows are written once to the shared folder: counting and numbering
    must see the same placement. So are the shifts of their parts: Spark then knows how
    small they are and broadcasts them, and no pass over the rows shuffles them for an id.
    """
    spark = df.sparkSession
    placed, places = with_places(df)
    if order_by:
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [*[col(c) for c in order_by], *places]
        placed = placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*places)
        placed, places = placed.withColumn(_AT, F.monotonically_increasing_id()), [_AT]
    part = F.xxhash64(_FILE, _SPLIT) if _FILE in places else F.shiftright(_AT, _POSITION_BITS)
    placed = materialise(placed.withColumn(_PART, part))
    # One row per split or partition: what its positions must be moved by to become ids.
    order = places[:-1] or [_PART]
    first, rows = F.min(_AT).alias("first"), F.count(F.lit(1)).alias("rows")
    parts = placed.groupBy(_PART).agg(first, rows, *[F.min(c).alias(c) for c in order if c != _PART])
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("rows").over(before), F.lit(0))
    parts = materialise(parts.select(_PART, (start - F.col("first")).alias("_tw_shift")))
    numbered = placed.join(parts, _PART).withColumn(name, F.col(_AT) + F.col("_tw_shift"))
    return numbered.select(*[col(c) for c in df.columns if c != name], col(name))


def _fixed_width(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_fixed_width(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def block_rows_for(df: DataFrame, row_id: str) -> int:
    """Rows per block: a million, more when that would give too many blocks."""
    last = df.agg(F.max(col(row_id))).first()[0]
    return max(BLOCK_ROWS, -(-((last or 0) + 1) // MAX_BLOCKS))


def carry_last(
    df: DataFrame,
    wanted: Mapping[str, Column],
    row_id: str = ROW_ID,
    before: Mapping[str, Column] | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """For each row, the last non-NULL value of an expression at or before it.

    `wanted` maps new column names to expressions; those in `before` look at
    earlier rows only. Inside a block this is a window over at most one block of
    rows; across blocks the last value of each block (one row per block, at most
    MAX_BLOCKS of them) is carried on and joined back. Numbers and dates are
    broadcast; texts have no size bound, so they join by the block the window
    needs anyway.
    """
    size = block_rows or block_rows_for(df, row_id)
    everything = {**wanted, **(before or {})}
    names = list(everything)
    block = F.expr(f"{quoted(row_id)} DIV {size}")
    blocked = df.withColumn("_tw_block", block).withColumns(
        {f"_tw_x{i}": everything[n] for i, n in enumerate(names)}
    )
    ends = blocked.groupBy("_tw_block").agg(
        *[
            F.max_by(f"_tw_x{i}", F.when(F.col(f"_tw_x{i}").isNotNull(), col(row_id))).alias(f"_tw_e{i}")
            for i in range(len(names))
        ]
    )
    # One row per block, bounded by MAX_BLOCKS, so one task may order them.
    earlier = Window.orderBy("_tw_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "_tw_block",
        *[F.last(f"_tw_e{i}", ignorenulls=True).over(earlier).alias(f"_tw_c{i}") for i in range(len(names))],
    )
    order = Window.partitionBy("_tw_block").orderBy(col(row_id))
    inside = {
        n: order.rowsBetween(Window.unboundedPreceding, 0 if n in wanted else -1) for n in names
    }
    if all(_fixed_width(blocked.schema[f"_tw_x{i}"].dataType) for i in range(len(names))):
        carried = F.broadcast(carried)
    filled = blocked.join(carried, "_tw_block").withColumns(
        {
            n: F.coalesce(F.last(f"_tw_x{i}", ignorenulls=True).over(inside[n]), F.col(f"_tw_c{i}"))
            for i, n in enumerate(names)
        }
    )
    return filled.drop(
        "_tw_block", *[f"_tw_x{i}" for i in range(len(names))], *[f"_tw_c{i}" for i in range(len(names))]
    )


def carry_both(
    df: DataFrame, wanted: Mapping[str, Column], row_id: str = ROW_ID, block_rows: int | None = None
) -> DataFrame:
    """For each row, `<name>_before` and `<name>_after`: the last non-NULL value of an expression at
    or before it and the first one at or after it.

    Both directions share the blocks, their one shuffle and their one sort. What a block lacks
    comes from the blocks around it: a row per block (at most MAX_BLOCKS) with the nearest
    value on either side. Blocks are equal stretches of row ids, so a long gap or a hot key
    is no hot task.
    """
    size = block_rows or block_rows_for(df, row_id)
    names = list(wanted)
    xs = [f"_tw_x{i}" for i in range(len(names))]
    blocked = df.withColumn("_tw_block", F.expr(f"{quoted(row_id)} DIV {size}")).withColumns(
        {x: wanted[n] for x, n in zip(xs, names)}
    )
    known = {x: F.when(F.col(x).isNotNull(), col(row_id)) for x in xs}
    ends = blocked.groupBy("_tw_block").agg(
        *[F.max_by(x, known[x]).alias(f"{x}_last") for x in xs], *[F.min_by(x, known[x]).alias(f"{x}_first") for x in xs]
    )
    # One row per block, bounded by MAX_BLOCKS, so one task may order them.
    earlier = Window.orderBy("_tw_block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("_tw_block").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        "_tw_block",
        *[F.last(f"{x}_last", ignorenulls=True).over(earlier).alias(f"{x}_b") for x in xs],
        *[F.first(f"{x}_first", ignorenulls=True).over(later).alias(f"{x}_a") for x in xs],
    )
    if all(_fixed_width(blocked.schema[x].dataType) for x in xs):
        carried = F.broadcast(carried)
    order = Window.partitionBy("_tw_block").orderBy(col(row_id))
    upto, since = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    sides = {}
    for n, x in zip(names, xs):
        sides[f"{n}_before"] = F.coalesce(F.last(x, ignorenulls=True).over(upto), F.col(f"{x}_b"))
        sides[f"{n}_after"] = F.coalesce(F.first(x, ignorenulls=True).over(since), F.col(f"{x}_a"))
    filled = blocked.join(carried, "_tw_block").withColumns(sides)
    return filled.drop("_tw_block", *xs, *[f"{x}_b" for x in xs], *[f"{x}_a" for x in xs])
