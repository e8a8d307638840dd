"""Lempel-Ziv phrase fingerprints of documents and of their edited texts.

LZ78 parses the bytes of a text into phrases: each is the longest phrase met before in
this text, plus one byte. The fingerprint is a minimum-hash signature of the phrase set,
so its likeness estimates which share of phrases two texts have in common, much as
compressing one with the other's dictionary would. The parse runs from left to right,
hence an edited text that keeps its first half shares that part of the work.

The edited text of a document needs the next document's beginning. Rows are range-
partitioned by doc_id; each task holds two neighbours at a time. A partition's last
document meets the first of the next partition in a second, small step: its table has
two texts per partition.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import sliced, written
from .words import mix

SLOTS = 64  # minimum hashes of a fingerprint
GUESS = 5  # bytes a phrase often has

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_EDGES = f"{RESULT}, edge string, part int, text string"
_LANE = np.arange(SLOTS)


def parse(data: bytes, start: int, stop: int, seen: set[bytes]) -> int:
    """Parse data[start:] into `seen` while phrases end by `stop`; returns where it came to.
    A remainder that was seen before is left.

    The phrases seen are closed under prefixes, so the longest match can be looked for
    from a guessed length, up or down.
    """
    n = len(data)
    while start < stop:
        end = start + GUESS
        if data[start:end] in seen:
            while end < n:
                end += 1
                if data[start:end] not in seen:
                    break
            else:
                return start
        else:
            end = min(end, n)
            while end - 1 > start and data[start : end - 1] not in seen:
                end -= 1
        if end > stop:
            return start
        seen.add(data[start:end])
        start = end
    return start


def signature(seen: set[bytes]) -> np.ndarray:
    """One-permutation minimum hash: every phrase falls into one slot, whose least hash stays.
    Empty slots take the value of the next full one; without phrases all are zero."""
    if not seen:
        return np.zeros(SLOTS, np.uint32)
    out = np.full(SLOTS, 1 << 32, np.uint64)
    hashes = mix(np.fromiter(map(zlib.crc32, seen), np.uint64, len(seen)))
    np.minimum.at(out, (hashes & np.uint64(SLOTS - 1)).astype(np.int64), hashes >> np.uint64(32))
    full = np.flatnonzero(out < 1 << 32)
    return out[full[np.searchsorted(full, _LANE) % len(full)]].astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    data, seen = text.encode(), set()
    parse(data, 0, len(data), seen)
    return signature(seen)


def edit(text: str, following: str) -> tuple[str, int]:
    """`text` with its last half replaced by the beginning of `following`, and the bytes kept."""
    half = len(text) // 2
    kept = text[: len(text) - half]
    return kept + following[:half], len(kept.encode())


def both_fingerprints(text: str, edited: str, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of two texts whose first `kept` bytes are the same."""
    first, second = text.encode(), edited.encode()
    seen: set[bytes] = set()
    at = parse(first, 0, kept, seen)
    other = set(seen)
    parse(first, at, len(first), seen)
    parse(second, at, len(second), other)
    return signature(seen), signature(other)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def _judged(doc, text: str, following: str) -> tuple[list, np.ndarray]:
    """A result row without near_next, and the document's fingerprint."""
    edited, kept = edit(text, following)
    own, other = both_fingerprints(text, edited, kept)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return [doc, len(text), digest, _hex(own), _hex(other), likeness(own, other)], own


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], names=list(names))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    for batch in sliced(batches, "text", 1 << 20):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        yield from zip(batch.column("doc_id").to_pylist(), texts)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of a partition in descending order. The first and the last document come
    with their texts instead (edge is set); the last one's result row is left to `_across`."""
    part = TaskContext.get().partitionId()
    edge = [None] * 6
    rows: list = []
    before = own = held = None
    for doc, text in _texts(batches):
        if held is None:
            rows.append([doc, *edge, "first", part, text])
        else:
            row, held_print = _judged(*held, text)
            if before is not None:
                rows.append([*before, likeness(own, held_print), None, part, None])
            before, own = row, held_print
        held = doc, text
        if len(rows) >= 500:
            yield _batch(rows, _EDGES)
            rows = []
    if held is not None:
        if before is not None:
            rows.append([*before, likeness(own, fingerprint(held[1])), None, part, None])
        rows.append([held[0], *edge, "last", part, held[1]])
    yield _batch(rows, _EDGES)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of the partitions' last documents (doc_id, text, following)."""
    for batch in batches:
        rows = []
        for doc, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            row, own = _judged(doc, text, following)
            rows.append([*row, likeness(own, fingerprint(following))])
        yield _batch(rows, RESULT)


def lz_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (64 minimum hashes each, in hex), near_edited and near_next.

    The next document is the one of the next smaller doc_id; after the last comes the
    first. Rows of one doc_id follow each other by their texts; rows without doc_id come
    last. Null texts count as empty; two empty texts have likeness 1. A document that is
    alone is its own next one. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")), F.desc("text")]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    done = written(rows.mapInArrow(_neighbours, _EDGES))
    firsts = done.where("edge = 'first'").select("part", F.col("text").alias("following"))
    parts = firsts.select("part")  # a row per partition
    after = F.lead("part").over(Window.orderBy("part"))
    parts = parts.select("part", F.coalesce(after, F.min("part").over(Window.partitionBy())).alias("next"))
    lasts = done.where("edge = 'last'").join(parts, "part")
    lasts = lasts.select("doc_id", "text", "next").join(firsts.withColumnRenamed("part", "next"), "next")
    lasts = lasts.select("doc_id", "text", "following").mapInArrow(_across, RESULT)
    return done.where("edge IS NULL").select(*lasts.columns).union(lasts)
