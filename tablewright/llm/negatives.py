"""Hard negatives by BOND: vertical scans that shrink a bitmap of candidates.

Rows are dealt into blocks, and a block holds its vectors by dimension: one column of
integers for each. An anchor reads the columns in the order of its own components, the
largest magnitudes first. What the unread dimensions can still add lies between the
sums of its least and greatest contributions (from each column's minimum and maximum in
the block), so every candidate has a lower and an upper bound. Candidates that can't
reach any of the anchor's score windows, or can't be among a window's first, leave the
bitmap; those left at the end have exact scores.

Two searches, one for the positives (no window, same label) and one for the negatives (a
window for each positive, other labels). Every block meets every group of anchors: with
65,536 rows and 16,384 anchors each, some 10 MB are shuffled for several core-seconds of
work. Blocks are read in rounds, each of which has eight times the blocks of the ones
before: what the earlier rounds found raises the windows' lower ends, so a round returns
a few rows for each anchor whatever the number of blocks, and prunes from its start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .vectors import integers, matrix, usable

SCALE = 256
CLASSES = 10
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score, the window of its negatives
BLOCK_ROWS = 1 << 16
ANCHOR_ROWS = 1 << 14
SPREAD = 8  # blocks, and groups of anchors, that smaller tables are still dealt into
ROUND = 8  # blocks of the first round, and growth of the later ones
STEP = 8  # dimensions read between two looks at the bitmap
_END = 1 << 62


# --- one block ---------------------------------------------------------------------------


@dataclass
class Block:
    """Rows sorted by label; `columns[d]` holds dimension d of all of them."""

    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: float  # largest length of a vector

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray) -> Block:
        if not columns.size:
            columns = np.zeros((1, len(ids)), np.int64)
        lengths = np.sqrt((columns.astype(np.float64) ** 2).sum(0))
        return cls(ids, labels, columns, columns.min(1), columns.max(1), float(lengths.max()))

    def read_as(self, longest: float) -> np.ndarray:
        """The columns in the fastest type in which every partial sum with a vector of at most
        this length is exact: by Cauchy-Schwarz no sum exceeds the product of both lengths."""
        most = (self.norm + 1) * (longest + 1) * 1.001
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        return self.columns.astype(kind)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k + 16:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def scan(
    block: Block, columns: np.ndarray, anchor: np.ndarray, rows: list[slice], skip: int, windows: list[tuple[int, int, int]]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high, k) the ids and scores of the block's first k rows in it. Only
    `rows` count, and none of the id `skip`. `columns` is the block's `read_as`."""
    width = min(len(anchor), len(columns))
    a = anchor[:width]
    order = np.argsort(-np.abs(a), kind="stable")
    order = order[: np.count_nonzero(a)]
    one, other = a[order] * block.low[order], a[order] * block.high[order]
    rest_low = np.concatenate([np.cumsum(np.minimum(one, other)[::-1])[::-1], [0]])
    rest_high = np.concatenate([np.cumsum(np.maximum(one, other)[::-1])[::-1], [0]])
    factors = a[order].astype(columns.dtype)

    lowest, highest = min(w[0] for w in windows), max(w[1] for w in windows)
    span = max(min(w[1], 1 << 40) - w[0] if w[0] > -_END else _END for w in windows)
    # The bitmap starts as slices and becomes a list of positions when few are left.
    at: np.ndarray | None = None
    skipped = int(np.count_nonzero(block.ids == skip))
    whole = len(rows) == 1
    part = slice(rows[0].start, rows[-1].stop)
    sums = np.zeros(part.stop - part.start, columns.dtype)
    for start in range(0, len(order), STEP):
        dims = order[start : start + STEP]
        if at is None:
            sums = sums + factors[start : start + STEP] @ columns[dims, part]
        else:
            sums = sums + factors[start : start + STEP] @ columns[dims[:, None], at[None, :]]
        low, high = rest_low[min(start + STEP, len(order))], rest_high[min(start + STEP, len(order))]
        if not len(sums):
            break
        if high - low > 4 * span and float(sums.min()) + float(high) >= lowest:
            continue  # bounds are still too wide to tell anything
        needed = lowest
        if high - low <= span:
            needed = _END
            for w_low, w_high, k in windows:
                sure = sums[(sums + low >= w_low) & (sums + high <= w_high)]
                if at is None and not whole:  # rows that don't count must not raise a window
                    sure = sure[:0]
                last = len(sure) - k - skipped  # the first ones may all be rows to skip
                if last >= 0:
                    w_low = max(w_low, int(np.partition(sure, last)[last]) + int(low))
                needed = min(needed, w_low)
        alive = (sums >= needed - high) & (sums <= highest - low)
        left = int(np.count_nonzero(alive))
        if left * 2 < len(sums) or (at is not None and left < len(sums)):
            keep = np.flatnonzero(alive)
            if at is None:
                keep = keep if whole else _inside(keep, part, rows)
                sums, at = sums[keep], keep + part.start
            else:
                sums, at = sums[keep], at[keep]
    if at is None:
        keep = np.arange(len(sums)) if whole else _inside(np.arange(len(sums)), part, rows)
        sums, at = sums[keep], keep + part.start
    scores, ids = sums.astype(np.int64), block.ids[at]
    out = []
    for w_low, w_high, k in windows:
        inside = np.flatnonzero((scores >= w_low) & (scores <= w_high) & (ids != skip))
        chosen = inside[best(ids[inside], scores[inside], k)]
        out.append((ids[chosen], scores[chosen]))
    return out


def _inside(at: np.ndarray, part: slice, rows: list[slice]) -> np.ndarray:
    """Of the positions in `part` those that are in one of the slices."""
    keep = np.zeros(len(at), bool)
    for s in rows:
        keep |= (at >= s.start - part.start) & (at < s.stop - part.start)
    return at[keep]


# --- tables ------------------------------------------------------------------------------

_BLOCK = "block int, ids binary, labels binary, width int, kind string, columns array<binary>"
_FOUND = "anchor long, window int, id long, score long"


def _smallest(values: np.ndarray) -> str:
    most = int(np.abs(values).max()) if values.size else 0
    return "<i2" if most < 1 << 15 else "<i4"


def _pack(table: pa.Table) -> pa.Table:
    """The rows (block, id, label, v) of one block as one row, vectors by dimension."""
    labels = table.column("label").to_numpy()
    ids = table.column("id").to_numpy()
    v = matrix(table.column("v"))
    order = np.lexsort((ids, labels))
    columns = np.ascontiguousarray(v[order].T)
    kind = _smallest(columns)
    return pa.table(
        {
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "ids": [ids[order].astype("<i8").tobytes()],
            "labels": [labels[order].astype("<i8").tobytes()],
            "width": pa.array([len(columns)], pa.int32()),
            "kind": [kind],
            "columns": pa.array([[c.astype(kind).tobytes() for c in columns]], pa.list_(pa.binary())),
        }
    )


def _unpack(table: pa.Table) -> Block:
    row = {name: table.column(name)[0].as_py() for name in ("ids", "labels", "kind", "columns")}
    ids = np.frombuffer(row["ids"], "<i8")
    columns = np.array([np.frombuffer(c, row["kind"]) for c in row["columns"]], np.int64).reshape(-1, len(ids))
    return Block.of(ids, np.frombuffer(row["labels"], "<i8"), columns)


def blocks_of(rows: DataFrame, count: int, block_rows: int, spread: int) -> tuple[DataFrame, int]:
    """`rows` (id, label, v, place) in vertical blocks, and their number."""
    size = min(block_rows, max(4096, -(-count // spread)))
    blocks = max(1, -(-count // size))
    dealt = rows.select("id", "label", "v", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("block"))
    return written(dealt.groupBy("block").applyInArrow(_pack, _BLOCK)), blocks


def search(anchors: DataFrame, blocks: DataFrame, number: int, same: bool, anchor_rows: int, spread: int) -> DataFrame:
    """The first rows of each anchor's windows: (anchor, window, id, score).

    `anchors` has (anchor, id, label, v, windows: array of (window, low, high, k)); rows of
    the anchor's label count if `same`, the others if not, and never those of its id.
    """
    count = anchors.count()
    groups = max(1, -(-count // min(anchor_rows, max(64, -(-count // spread)))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            block = _unpack(right)
            vectors = matrix(left.column("v"))
            longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(1)).max())
            columns = block.read_as(longest)
            keys, ids, labels = (left.column(c).to_pylist() for c in ("anchor", "id", "label"))
            for key, own, label, v, windows in zip(keys, ids, labels, vectors, left.column("windows").to_pylist()):
                first, last = (int(np.searchsorted(block.labels, label, s)) for s in ("left", "right"))
                parts = [slice(first, last)] if same else [slice(0, first), slice(last, len(block.ids))]
                parts = [p for p in parts if p.stop > p.start]
                limits = [(w["low"], w["high"], w["k"]) for w in windows]
                if not parts or not limits:
                    continue
                for w, (at, scores) in zip(windows, scan(block, columns, v, parts, own, limits)):
                    found[0].append(np.full(len(at), key))
                    found[1].append(np.full(len(at), w["window"]))
                    found[2].append(at)
                    found[3].append(scores)
        columns = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in found]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "window", "id", "score"]
        )

    limits = anchors.select("anchor", F.inline("windows"))
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    have: DataFrame | None = None
    first, last = 0, ROUND
    while first < number:
        last = min(last, number)
        now = anchors
        if have is not None:
            # A window that has its k rows need not look below the last of them any more.
            full = have.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            raised = limits.join(full, ["anchor", "window"], "left").withColumn(
                "low", F.when(F.col("n") >= F.col("k"), F.greatest("low", "least")).otherwise(F.col("low"))
            )
            raised = raised.groupBy("anchor").agg(F.collect_list(F.struct("window", "low", "high", "k")).alias("windows"))
            now = anchors.drop("windows").join(raised, "anchor")
        group = F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int").alias("grp")
        left = now.select(
            group, F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("block"), "anchor", "id", "label", "v", "windows"
        )
        right = blocks.where((F.col("block") >= first) & (F.col("block") < last))
        right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
        met = left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(meet, _FOUND)
        if have is not None:
            met = have.union(met)
        met = met.join(limits.select("anchor", "window", "k"), ["anchor", "window"])
        met = met.withColumn("place", F.row_number().over(order)).where("place <= k")
        have = written(met.select("anchor", "window", "id", "score"))
        first, last = last, last * ROUND
    if have is None:
        return anchors.sparkSession.createDataFrame([], _FOUND)
    return have


def hard_negatives(
    embeddings: DataFrame,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
    spread: int = SPREAD,
) -> DataFrame:
    """Hard negatives of `embeddings` (vec_id, embedding, label; others are ignored): anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Rows take part if label, vector and all components are there and finite, and if they
    have a vec_id. Vectors of different lengths meet as if filled with zeros; an empty one
    scores 0. Rows that repeat a vec_id are rows of their own, and anchors of their own,
    but are never positive or negative for their own vec_id. Components from 2**26 / 256
    on raise an error, since scores would not fit. An empty table gives no rows.
    """
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, F.expr("(CAST(label AS BIGINT) + 1) % 10")).otherwise(label)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    rows = written(
        rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), integers(F.col("embedding"), SCALE).alias("v"))
    )
    place = F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    rows = rows.select("id", "label", "v", place.alias("place"))
    blocks, number = blocks_of(rows, rows.count(), block_rows, spread)

    anchors = rows.where("id % 50 = 0").select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "v")
    anchors = written(anchors)
    every = F.array(
        F.struct(
            F.lit(0).alias("window"), F.lit(-_END).alias("low"), F.lit(_END).alias("high"), F.lit(POSITIVES).alias("k")
        )
    )
    found = search(anchors.withColumn("windows", every), blocks, number, True, anchor_rows, spread)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    positives = found.select(
        "anchor",
        (F.row_number().over(order) - 1).alias("window"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    # floor and ceiling of whole numbers: 50 p <= 100 n <= 95 p
    low = F.expr(f"-(({-LOW} * positive_score - pmod({-LOW} * positive_score, 100)) div 100)")
    high = F.expr(f"({HIGH} * positive_score - pmod({HIGH} * positive_score, 100)) div 100")
    windows = F.struct("window", low.alias("low"), high.alias("high"), F.lit(NEGATIVES).alias("k"))
    wanted = positives.where(low <= high).groupBy("anchor").agg(F.collect_list(windows).alias("windows"))
    wanted = written(anchors.join(wanted, "anchor"))
    negatives = search(wanted, blocks, number, False, anchor_rows, spread)
    ranked = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    names = anchors.select("anchor", F.col("id").alias("anchor_id"))
    out = negatives.withColumn("rank", F.row_number().over(ranked)).join(positives, ["anchor", "window"])
    return out.join(names, "anchor").select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
