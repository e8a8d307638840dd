"""Substring deduplication by paragraphs and by passages inside them.

Paragraphs are lines of enough words. Shorter lines that follow each other are joined into
paragraphs, which end before lines whose hash is the largest among those nearby; what is
too short even so is joined with the line next to it. Paragraphs get MinHash bands over
their five-word shingles, tuned for recall at the similarity asked for; paragraphs that
share a band are compared by their exact Jaccard similarity, and connected components
decide what goes.

A passage may be repeated inside longer paragraphs, or in lines of few words. So whole
texts are also cut into short blocks where a hash of two words is the largest among its
neighbours: the cuts depend on nearby words only, so a repeated passage is cut alike
wherever it stands and however its lines break. Lines are cut at their ends as well, so
that lines repeated between others are found whole. Blocks are compared as they are, and
count where enough of them follow each other.

Repeats within one document alone are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .ngram_join import bitmap, similar_pairs
from .tables import sliced, written
from .words import _distinct, mix, shingles, utf8, word_hashes, word_spans

SIMILARITY = 0.8
RECALL = 0.98
LEAST_LINE = 20  # words of a paragraph
LEAST_PASSAGE = 16  # words of blocks in a row
GAP = 8  # words between blocks of one passage
REACH = 4  # words on either side that a cut looks at
LEAST_BLOCK = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tuned(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the fewest minimum hashes whose bands find similar pairs with this
    recall, and at most four in a thousand pairs of a tenth of the similarity."""
    best = None
    for rows in range(2, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        false = 1 - (1 - (similarity / 10) ** rows) ** bands
        if false <= 4e-3 and (best is None or bands < best[0]):
            best = bands, rows
    return best


BANDS, ROWS = tuned()


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, offsets of lines in them, and the row of each line."""
    raw, rows = utf8(column)
    starts, ends, bounds = word_spans(raw, rows)
    hashes = word_hashes(raw, starts, ends)
    breaks = np.cumsum(raw == 10)[starts] if len(starts) else np.zeros(0, np.int64)
    row = np.searchsorted(bounds, np.arange(len(starts)), "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return hashes, np.concatenate([first, [len(starts)]]), row[first] if len(first) else row


def sequence_hash(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the words of each stretch, in order."""
    if len(offsets) < 2:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
    return mix(np.add.reduceat(mix(hashes + at.astype(np.uint64) * _ODD), offsets[:-1]))


def band_hashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per stretch of words (none empty), one column per band."""
    grams, at = shingles(hashes, offsets)
    out = np.empty((len(offsets) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(out), band, np.uint64)
        for row in range(ROWS):
            salt = np.uint64(2 * (band * ROWS + row) + 1)
            least = np.minimum.reduceat(mix((grams ^ (salt * _ODD)) * (salt + _ODD + np.uint64(1) | np.uint64(1))), at[:-1])
            key = mix(key * _ODD + least)
        out[:, band] = key
    return out


def blocks(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Offsets of blocks: texts, given by their offsets, cut where a hash of two words is the
    largest within reach."""
    n = len(hashes)
    text = np.repeat(np.arange(len(texts) - 1), np.diff(texts))
    following = np.concatenate([hashes[1:], np.zeros(min(n, 1), np.uint64)])
    following[texts[1:] - 1] = 0
    score = mix(hashes + following * _ODD)
    top = np.ones(n, bool)
    for k in range(1, REACH + 1):
        if n > k:
            apart = text[k:] != text[:-k]
            top[k:] &= (score[k:] > score[:-k]) | apart
            top[:-k] &= (score[:-k] >= score[k:]) | apart
    top[texts[:-1]] = True
    return np.concatenate([np.flatnonzero(top), [n]])


def line_blocks(cut: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and sizes of the blocks `cut`, and of those that ends of lines cut further."""
    finer = np.union1d(cut, at)
    whole = np.isin(finer[:-1], cut) & np.isin(finer[1:], cut)
    more = np.flatnonzero(~whole)
    return np.concatenate([cut[:-1], finer[more]]), np.concatenate([np.diff(cut), np.diff(finer)[more]])


def paragraphs(hashes: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of all paragraphs of at least LEAST_LINE words: long lines, runs of
    short ones, and runs too short for that together with the line next to them."""
    size = np.diff(at)
    short = size < LEAST_LINE
    begins = np.ones(len(size), bool)
    begins[1:] = (row[1:] != row[:-1]) | (short[1:] != short[:-1]) | ~short[1:]
    run = np.cumsum(begins)
    score, cut = sequence_hash(hashes, at), np.ones(len(size), bool)
    for k in range(1, min(LEAST_LINE, len(size))):
        apart = (run[k:] != run[:-k]) | (at[k:-1] - at[: -1 - k] >= LEAST_LINE)
        cut[k:] &= (score[k:] > score[:-k]) | apart
        cut[:-k] &= (score[:-k] >= score[k:]) | apart
    # The first and the last piece of a run go to the one beside them if they are too short.
    stops = np.append(np.flatnonzero(begins)[1:], len(size))[run - 1]
    since = at[:-1] - at[np.flatnonzero(begins)[run - 1]]
    cut = begins | cut & (since >= LEAST_LINE) & (at[stops] - at[:-1] >= LEAST_LINE)
    first = np.flatnonzero(cut)
    stop = np.append(first[1:], len(size))
    low = at[stop] - at[first] < LEAST_LINE
    after = low & (stop < len(size)) & (row[np.minimum(stop, len(size) - 1)] == row[first])
    before = low & ~after & (first > 0) & (row[np.maximum(first - 1, 0)] == row[first])
    stop, first = stop + after, first - before
    fits = at[stop] - at[first] >= LEAST_LINE
    return at[first[fits]], at[stop[fits]]


def _stretches(hashes: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of stretches that may overlap, one after another, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(ends - first)])
    return hashes[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], ends - first)], offsets


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, doc_id, first, words, node): a block (without node), or a band of a paragraph."""
    for batch in sliced(batches, "text"):
        docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
        known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        hashes, at, row = lines(batch.column("text"))
        if not len(hashes):
            continue
        _, first_line = np.unique(row, return_index=True)
        begin = np.zeros(batch.num_rows, np.int64)
        begin[row[first_line]] = at[first_line]

        of = np.repeat(row, np.diff(at))
        texts = np.concatenate([at[first_line], [len(hashes)]])
        block, sizes = line_blocks(blocks(hashes, texts), at)
        varied = np.ones(len(hashes), np.int64)
        varied[2:] = (hashes[2:] != hashes[1:-1]) & (hashes[2:] != hashes[:-2])
        varied = np.concatenate([[0], np.cumsum(varied)])
        good = (sizes >= LEAST_BLOCK) & (varied[block + sizes] - varied[block] >= LEAST_BLOCK - 1)
        good &= known[of[block]]
        block, sizes = block[good], sizes[good]
        sig = mix(sequence_hash(*_stretches(hashes, block, block + sizes)))
        parts = [(sig, of[block], block, sizes, None)]

        first, ends = paragraphs(hashes, at, row)
        some = np.zeros(len(hashes), np.int64)
        some[1:] = hashes[1:] != hashes[:-1]
        some = np.concatenate([[0], np.cumsum(some)])
        fits = (some[ends] - some[first] >= LEAST_LINE // 2) & known[of[first]]
        first, ends = first[fits], ends[fits]
        if len(first):
            words, offsets = _stretches(hashes, first, ends)
            bands = band_hashes(words, offsets)
            node = np.repeat(sequence_hash(words, offsets), BANDS)
            first, ends = np.repeat(first, BANDS), np.repeat(ends, BANDS)
            parts.append((bands.ravel(), of[first], first, ends - first, node))
        for sig, r, first, words, node in parts:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sig.view(np.int64)),
                    pa.array(docs[r].astype(np.int64)),
                    pa.array((first - begin[r]).astype(np.int32)),
                    pa.array(words.astype(np.int32)),
                    pa.nulls(len(sig), pa.int64()) if node is None else pa.array(node.view(np.int64)),
                ],
                names=["sig", "doc_id", "first", "words", "node"],
            )


def _line_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, shingles, bits, n) of every paragraph long enough."""
    for batch in sliced(batches, "text"):
        hashes, at, row = lines(batch.column("text"))
        if not len(hashes):
            continue
        first, last = paragraphs(hashes, at, row)
        if not len(first):
            continue
        words, at = _stretches(hashes, first, last)
        node = sequence_hash(words, at)
        grams, offsets = shingles(words, at)
        sets = [_distinct(grams[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(node.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))),
                pa.array([bitmap(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
            ],
            names=["id", "shingles", "bits", "n"],
        )


def _across(rows: DataFrame, key: str) -> DataFrame:
    """`rows` whose key occurs in several documents, and whether they are, or overlap, the first
    place it occurs at. Hot keys combine before the shuffle, and the sums are written: joining
    them back is a plain join that Spark splits."""
    place = F.struct("doc_id", "first", "words")
    groups = rows.groupBy(key).agg(F.min(place).alias("origin"), F.max("doc_id").alias("last"))
    groups = written(groups.where("origin.doc_id <> last").drop("last"))
    kept = F.expr("doc_id = origin.doc_id AND first < origin.first + origin.words")
    return rows.join(groups, key).withColumn("kept", kept).drop("origin")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per repeated piece of text: doc_id, kind (`paragraph` or `passage`), first_word,
    n_words, component, kept.

    Words count from 0 in the whole text; A-Z are lower-cased. A component holds pieces
    that repeat each other in at least two documents; its first one (by doc_id and place)
    is kept, all others are to be removed. Rows without text or doc_id have no pieces; rows
    that repeat a doc_id count as one document. Pieces that repeat one or two words over
    and over are passed by. Pieces may overlap; pieces that overlap the first one of their
    component are kept with it. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = docs.mapInArrow(_units, "sig long, doc_id long, first int, words int, node long")
    shared = units.groupBy("sig").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = written(shared.where("low <> high").select("sig"))
    hits = written(units.join(shared, "sig"))

    found = written(_across(hits.where("node IS NULL").select("sig", "doc_id", "first", "words"), "sig"))
    places = Window.partitionBy("doc_id").orderBy("first", "words").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("end", F.max(F.col("first") + F.col("words")).over(places))
    new = F.when(F.col("first") <= F.col("end") + GAP, 0).otherwise(1)
    more = F.col("first") + F.col("words") - F.greatest("first", F.coalesce("end", "first"))
    found = found.withColumn("new", new).withColumn("more", F.greatest(more, F.lit(0)))  # words of no block before
    found = found.withColumn("passage", F.sum("new").over(places.rowsBetween(Window.unboundedPreceding, 0)))
    long = F.sum("more").over(Window.partitionBy("doc_id", "passage")) >= LEAST_PASSAGE
    found = found.withColumn("long", long).where("long")
    passages = found.select("doc_id", F.lit("passage").alias("kind"), "first", "words", F.col("sig").alias("component"), "kept")

    paragraphs = written(hits.where("node IS NOT NULL").select("node", "doc_id", "first", "words").distinct())
    buckets = hits.where("node IS NOT NULL").select("sig", F.col("node").alias("id")).distinct()
    homes = paragraphs.groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    made: list[DataFrame] = []

    def bits(wanted: DataFrame) -> DataFrame:
        some = homes.join(wanted.withColumnRenamed("id", "node"), "node", "left_semi").select("doc_id").distinct()
        rows = docs.join(some, "doc_id", "left_semi")
        rows = rows.mapInArrow(_line_vectors, "id long, shingles array<long>, bits binary, n long")
        made.append(written(rows.join(wanted, "id", "left_semi").dropDuplicates(["id"])))
        return made[0].select("id", "bits", "n")

    def sets(wanted: DataFrame) -> DataFrame:
        return made[0].select("id", "shingles").join(wanted, "id", "left_semi")

    labels = components(similar_pairs(buckets, bits, sets)).withColumnRenamed("id", "node")
    paragraphs = paragraphs.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    paragraphs = _across(paragraphs.select("component", "doc_id", "first", "words"), "component")
    paragraphs = paragraphs.select("doc_id", F.lit("paragraph").alias("kind"), "first", "words", "component", "kept")
    return paragraphs.union(passages).withColumnsRenamed({"first": "first_word", "words": "n_words"})
