"""Token ids in grammar-compressed shards (Re-Pair), with random access.

Documents are encoded in doc_id order and cut into shards of whole documents. In each
shard frequent pairs of neighbouring ids become new symbols, round after round; pairs
never reach past a document's end, so each document is a run of whole symbols. A shard
holds the rules, the number of ids each rule stands for, the remaining sequence, and
where each document starts in it. One shard is one row of a parquet table, written by
Spark: a task that is run again replaces its own files only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import lean, sliced
from .tokens import words_of

SHARD = 1 << 20  # ids of a shard, unless one document has more
SLOTS = 18  # bits of the table that counts pairs by hash
PAIRS = 8192  # new symbols a round
LEAST = 8  # times a pair must occur
FEW = 0.99  # rounds end with one that leaves more than this share of the symbols
FIRST = 1 << 16  # new symbols count from here; ids are smaller
_MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sBxxxqqqq")


@dataclass
class Shard:
    docs: np.ndarray  # start of each document in `sequence`, and the end
    rounds: np.ndarray  # number of rules after each round
    rules: np.ndarray  # (left, right) of symbol FIRST + i
    lengths: np.ndarray  # ids that symbol FIRST + i stands for
    sequence: np.ndarray


def compress(ids: np.ndarray, ends: np.ndarray) -> Shard:
    """`ids` of whole documents, `ends` their end positions. Long runs of replacements in one
    round take every second pair, so none overlap."""
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    size = np.ones(FIRST, np.int64)
    rules, rounds = [np.zeros((0, 2), np.int64)], []
    while True:
        keys = seq[:-1] << 32 | seq[1:]
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        slot[last[:-1]] = 1 << SLOTS
        counts = np.bincount(slot, minlength=(1 << SLOTS) + 1)
        counts[-1] = 0
        enough = max(LEAST, int(np.partition(counts, -PAIRS)[-PAIRS]))
        at = np.flatnonzero(counts[slot] >= enough)
        pair = np.zeros((1 << SLOTS) + 1, np.int64)
        pair[slot[at]] = keys[at]  # one pair of each frequent slot is replaced in this round
        at = at[pair[slot[at]] == keys[at]]
        often = np.bincount(slot[at], minlength=(1 << SLOTS) + 1)
        at = at[often[slot[at]] >= LEAST]
        if not len(at):
            break
        breaks = np.concatenate([[True], np.diff(at) > 1])
        run = np.maximum.accumulate(np.where(breaks, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - run) % 2 == 0
        at = at[keep]
        used = np.unique(slot[at])
        names = np.zeros((1 << SLOTS) + 1, np.int64)
        names[used] = np.arange(len(used))
        left, right = pair[used] >> 32, pair[used] & 0xFFFFFFFF
        rules.append(np.stack([left, right], 1))
        seq[at] = len(size) + names[slot[at]]
        size = np.concatenate([size, size[left] + size[right]])
        last[at] = last[at + 1]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        before = len(seq)
        seq, last = seq[stays], last[stays]
        rounds.append(len(size) - FIRST)
        if len(seq) > FEW * before:
            break
    docs = np.concatenate([[0], np.flatnonzero(last) + 1])
    return Shard(docs, np.array(rounds, np.int64), np.concatenate(rules), size[FIRST:], seq)


def to_bytes(shard: Shard) -> bytes:
    top = FIRST + len(shard.rules)
    width = 3 if top < 1 << 24 else 4
    symbols = np.concatenate([shard.rules.ravel(), shard.sequence]).astype("<u4")
    head = _HEAD.pack(_MAGIC, width, len(shard.docs), len(shard.rounds), len(shard.rules), len(shard.sequence))
    parts = [a.astype("<i8").tobytes() for a in (shard.docs, shard.rounds)]
    parts += [shard.lengths.astype("<u4").tobytes(), symbols.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()]
    return b"".join([head, *parts])


def from_bytes(data: bytes) -> Shard:
    magic, width, docs, rounds, rules, sequence = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a shard of this format")
    at = _HEAD.size
    numbers = np.frombuffer(data, "<i8", docs + rounds, at)
    at += 8 * len(numbers)
    lengths = np.frombuffer(data, "<u4", rules, at).astype(np.int64)
    at += 4 * rules
    raw = np.frombuffer(data, np.uint8, (2 * rules + sequence) * width, at).reshape(-1, width)
    symbols = np.zeros((len(raw), 4), np.uint8)
    symbols[:, :width] = raw
    symbols = symbols.view("<u4").ravel().astype(np.int64)
    return Shard(numbers[:docs], numbers[docs:], symbols[: 2 * rules].reshape(-1, 2), lengths, symbols[2 * rules :])


class Decoder:
    """What every symbol of a shard stands for."""

    def __init__(self, shard: Shard):
        self.shard = shard
        self.flat = np.arange(FIRST, dtype=np.uint32)
        self.size = np.concatenate([np.ones(FIRST, np.int64), shard.lengths])
        self.at = np.arange(FIRST, dtype=np.int64)
        done = 0
        for upto in shard.rounds.tolist():
            more = self.expand(shard.rules[done:upto].ravel())
            sizes = self.size[FIRST + done : FIRST + upto]
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat = np.concatenate([self.flat, more])
            done = upto

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.size[symbols]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[symbols] - ends + sizes, sizes) + np.arange(total)]

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of the k-th document: only symbols that overlap them expand."""
        symbols = self.shard.sequence[self.shard.docs[k] : self.shard.docs[k + 1]]
        ends = np.cumsum(self.size[symbols])
        stop = int(ends[-1]) if stop is None else stop
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        skipped = int(ends[first - 1]) if first else 0
        return self.expand(symbols[first : last + 1])[start - skipped : stop - skipped]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard: int = SHARD) -> None:
    """Encode every whole text (null: empty), append `end_id`, and write shards to `path`, in
    ascending doc_id order (rows without one first, equal ones by text)."""

    @partial(lean, tokens=True)
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer, True)
        end = int(end_id).to_bytes(4, "little")
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in held])
            data = to_bytes(compress(np.frombuffer(b"".join(held), "<u4"), ends))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            values = [[part], [number], [size // 4], [ids], [data]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)], names=["part", "number", "n_ids", "doc_ids", "shard"]
            )

        for batch in sliced(batches, "text", 1 << 20):
            for doc, coded in zip(batch.column("doc_id").to_pylist(), words.ids(batch.column("text"))):
                if held and size + len(coded) + 4 > 4 * shard:
                    yield out()
                    number, ids, held, size = number + 1, [], [], 0
                ids.append(doc)
                held.append(coded + end)
                size += len(coded) + 4
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(shards, "part int, number int, n_ids long, doc_ids array<long>, shard binary").write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, docs, data in zip(*(batch.column(c) for c in ("part", "number", "doc_ids", "shard"))):
            shard = from_bytes(data.as_py())
            decoder = Decoder(shard)
            sizes = np.concatenate([[0], np.cumsum(decoder.size[shard.sequence])])[shard.docs]
            ids = decoder.expand(shard.sequence).astype("<u4")
            n = len(shard.docs) - 1
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(sizes[:-1], sizes[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.as_py()] * n, pa.int32()),
                    pa.array([number.as_py()] * n, pa.int32()),
                    pa.array(docs.as_py(), pa.int64()),
                    pa.array(sizes[:-1]),
                    pa.array(np.diff(sizes)),
                    pa.array(sums, pa.int64()),
                ],
                names=["part", "number", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "number", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("earlier", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "number", (F.col("before") + F.col("earlier")).alias("first"))
    schema = "part int, number int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    rows = shards.mapInArrow(_decoded, schema).join(starts, ["part", "number"])
    return rows.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
