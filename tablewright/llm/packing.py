"""Best-fit packing of token pieces with certified bin counts.

Texts become pieces of at most `length` tokens. Partitions of pieces are packed by
best-fit decreasing, and dual feasible functions give each partition a lower bound on
its number of sequences. A partition that meets its bound is certified and done. Those
with a gap give up the sequences that are not nearly full; their pieces meet in fewer
partitions and are packed again, until all are certified, a round wins nothing, or one
partition is left. Only a few numbers per partition reach the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import lean, sliced, written
from .tokens import words_of

LENGTH = 2048
GROUP = 40_000  # pieces a partition packs
FULL = 0.995  # share of a sequence from which it is left alone
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_rows(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """The pieces of every row: ids of the whole text (null: empty), then `end_id`. Only
    longer documents are cut, every `length` ids."""

    @partial(lean, tokens=True)
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer, False)
        end = int(end_id).to_bytes(4, "little")
        for batch in sliced(batches, "text", 1 << 20):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.ids(batch.column("text"))):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(pieces, PIECE)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and place of each length. Open bins are kept by room."""
    bins = np.empty(len(lengths), np.int64)
    places = np.empty(len(lengths), np.int64)
    with_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            stack = with_room[room]
            chosen = stack.pop()
            if not stack:
                del rooms[at]
        else:
            room, chosen, opened = size, opened, opened + 1
        bins[i], places[i] = chosen, size - room
        left = room - need
        if left:
            stack = with_room.setdefault(left, [])
            if not stack:
                insort(rooms, left)
            stack.append(chosen)
    return bins, places


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """No packing needs fewer bins: the best of the dual feasible functions that count
    pieces over size - t whole, drop those under t, and leave or halve the rest, and of
    the rounding functions floor((k + 1) x / size) / k, with every threshold tried."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    tokens, number = np.cumsum(count * x), np.cumsum(count)
    t = np.arange(0, size // 2 + 1)
    above = number[-1] - number[size - t]
    below = np.where(t > 0, tokens[t - 1], 0)
    between = tokens[size - t] - below
    best = int(np.max(above + -(-between // size)))
    half = number[-1] - number[size // 2]
    best = max(best, int(half + -(-int(count[size // 2] if size % 2 == 0 else 0) // 2)))
    for k in range(1, 101):
        scaled = (k + 1) * x
        value = np.where(scaled % size == 0, k * scaled // (k + 1), size * (scaled // size))
        total = int((count * value).sum())
        best = max(best, -(-total // (k * size)))
    return best


def _pack(pieces: DataFrame, groups: int, tag: int, size: int) -> DataFrame:
    """`pieces` with group, bin, offset, and their group's number of bins and lower bound."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "place"], ascending=False, kind="stable")
        lengths = rows["length"].to_numpy()
        bins, places = best_fit(lengths, size)
        used = int(bins.max()) + 1
        fill = np.bincount(bins, lengths, used)
        return rows.assign(
            round=tag, bin=bins, offset=places, fill=fill[bins].astype(np.int64), bins=used, bound=lower_bound(lengths, size)
        )

    schema = f"{PIECE}, place string, grp int, round int, bin long, offset long, fill long, bins long, bound long"
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("place", F.lit(tag)), F.lit(groups)).cast("int"))
    return written(dealt.groupBy("grp").applyInPandas(pack, schema))


def pack(pieces: DataFrame, size: int = LENGTH, group: int = GROUP) -> DataFrame:
    """`pieces` with sequence_id and offset, and whether its partition's count is certified.

    Rows may repeat. No piece is longer than `size`.
    """
    pieces = written(pieces)
    place = F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    left = pieces.select(*pieces.columns, place.alias("place"))
    groups = max(1, -(-left.count() // group))
    done: list[DataFrame] = []
    tag, before = 0, None
    while True:
        packed = _pack(left, groups, tag, size)
        totals = packed.select("grp", "bins", "bound").distinct()
        used, bound = totals.agg(F.sum("bins"), F.sum("bound")).first()
        gap = (used or 0) - (bound or 0)
        packed = packed.withColumn("certified", F.col("bins") == F.col("bound"))
        if gap == 0 or groups == 1 or (before is not None and gap >= before):
            done.append(packed)
            break
        stays = F.col("certified") | (F.col("fill") >= F.lit(FULL * size))
        done.append(packed.where(stays))
        left = packed.where(~stays).select(*pieces.columns, "place")
        groups = max(1, groups // 4, -(-left.count() // group))
        tag, before = tag + 1, gap
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # in longs: `grp` and 1 << 26 are ints, whose product is beyond an int from the 33rd partition on
    number = F.col("round") * F.lit(1 << 52) + F.col("grp").cast("long") * F.lit(1 << 26) + F.col("bin")
    all_rows = done[0]
    for more in done[1:]:
        all_rows = all_rows.unionByName(more)
    return all_rows.select(*columns, number.cast("long").alias("sequence_id"), "offset", "certified")
