"""Near-duplicate documents by MinHash with tensored banding.

A table of a banding scheme needs a key of several minimum hashes, and high recall needs
many tables. Here keys are not made one by one. Two small collections of partial keys,
each of ROWS minimum hashes, are computed for every set, and table (i, j) takes the i-th
partial key of the one and the j-th of the other: SIDE * SIDE tables of 2 * ROWS hashes
from 2 * SIDE * ROWS hashes, about the square root of what separate tables would need.
Two sets of similarity s meet if a partial key of either collection agrees, with
probability (1 - (1 - s ** ROWS) ** SIDE) ** 2, and SIDE is the least for the recall asked for.

Only the partial keys are written; tables are unfolded when they are grouped. Equal sets
are one set from the start. Pairs that share a table's key are candidates only: bitmaps
rule most of them out, and full sets confirm the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngram_join import PERCENT, bits_of, digests, sets_of, similar_pairs
from .tables import lean, release, sliced, written
from .words import mix, shingle_sets

WORDS = 4  # of a shingle
RECALL = 0.9999  # of a pair that is just similar enough
ROWS = 2  # minimum hashes of a partial key
_ODD = np.uint64(0x9E3779B97F4A7C15)


def side(recall: float = RECALL, similarity: float = PERCENT / 100, rows: int = ROWS) -> int:
    """Partial keys in each of the two collections: the fewest for this recall."""
    return math.ceil(math.log(1 - math.sqrt(recall)) / math.log(1 - similarity**rows))


def partial_keys(sets: list[np.ndarray], number: int, rows: int = ROWS) -> np.ndarray:
    """One row per set (none empty) of `number` partial keys."""
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    salts = mix(np.arange(1, 2 * number * rows + 1, dtype=np.uint64) * _ODD).reshape(number, rows, 2)
    out = np.zeros((len(sets), number), np.uint64)
    if len(sets):
        for k in range(number):
            for flip, factor in salts[k]:
                least = np.minimum.reduceat((values ^ flip) * (factor | np.uint64(1)), starts)
                out[:, k] = mix(out[:, k] * _ODD + least + np.uint64(k))
    return out


def _sketched(number: int):
    @lean
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text"), WORDS)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), 2 * number), np.uint64)
            keys[some] = partial_keys([sets[i] for i in some], 2 * number)
            one, other = digests(sets)
            parts = [_lists(keys[:, :number]), _lists(keys[:, number:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(other), *parts],
                names=["doc_id", "n_shingles", "one", "other", "first", "second"],
            )

    return sketched


def _lists(keys: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(keys).view(np.int64).ravel()))


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, copies.

    `copies` counts the rows with the same shingle set. Null, empty and blank texts have
    n_shingles 0 and are linked with nothing. Rows without doc_id have no component and are
    kept. Rows that repeat a doc_id count as one document with several texts, and are kept
    or dropped together. `recall` is the least share of pairs of just the least similarity
    that meet in a table; pairs that are more similar meet more often. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, one long, other long, first array<long>, second array<long>"
    sketches = written(docs.mapInArrow(_sketched(side(recall)), schema))
    digest = ["n_shingles", "one", "other"]
    # Sums are written before they are joined back: a hot set's rows can then be split.
    equal = written(sketches.groupBy(*digest).agg(F.min("doc_id").alias("same"), F.count("*").alias("copies")))
    sets = written(sketches.drop("first", "second").join(equal, digest).drop("one", "other"))
    links = sets.where("n_shingles > 0 AND doc_id <> same").select(F.col("doc_id").alias("a"), F.col("same").alias("b"))

    # One row per set: of equal sets that of the smallest doc_id, of its repeats any.
    alone = equal.where("n_shingles > 0 AND same IS NOT NULL").withColumnRenamed("same", "doc_id").drop("copies")
    alone = sketches.join(alone, ["doc_id", *digest]).dropDuplicates(["doc_id", *digest])
    tables = alone.select(F.col("doc_id").alias("id"), F.posexplode("first").alias("i", "left"), "second")
    tables = tables.select("id", "i", "left", F.posexplode("second").alias("j", "right"))
    tables = tables.select(F.xxhash64("i", "left", "j", "right").alias("sig"), "id")
    near = similar_pairs(tables, lambda ids: bits_of(docs, ids, WORDS), lambda ids: sets_of(docs, ids, WORDS))
    labels = components(links.union(near)).toDF("doc_id", "component_id")
    release(spark)
    out = sets.join(labels, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "copies")
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "copies")
