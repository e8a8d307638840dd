"""N-gram Jaccard join by PartEnum signatures.

Two documents link when the Jaccard similarity of their shingle sets is at least 0.8.
For sets of at most r shingles that means at most k = (|x| + |y|) / 9 <= 2r / 9 shingles
in one set only. Sets of about equal size form a band; within a band the domain of
shingles is split into n1 parts and each part into n2 pieces (both by shingle hash).
If a pair differs in at most k shingles, then at least n1 - k // (k2 + 1) parts differ in
at most k2, and in such a part the sets agree on some n2 - k2 whole pieces. A signature
hashes the shingles of one such choice of pieces, so similar sets share one. Sets near
the lower end of the next band also sign there.

A choice that holds none of a set's shingles would throw all such sets together. But a
set that can differ from its partners in k_x shingles agrees with each of them in at
least n1 - k_x // (k2 + 1) parts. So a set with fewer parts that have an empty choice
leaves out the empty signatures: one that is not empty is shared all the same. The few
other sets write them all. Plans are chosen so that they are few. Nothing is lost.

Signatures only propose. Within a bucket, members are first checked against few centres;
after that only members of different components are compared, by an exact lower bound on
their difference (bitmaps) and then by the sets themselves, which only the survivors of the
bitmaps are asked for. So copies in thousands need no pairs, and texts are not shuffled.
Signatures that a batch holds many times are known to be shared: all but two of their rows
go round the shuffle that finds out, so a hot signature is no hot task there; all other
steps group it with sums before the shuffle and write the sums, or join them back, which Spark
can then split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.storage import copies, drop_copies

from .components import components
from .tables import lean, release, sliced, written
from .words import SHINGLE, mix, shingle_sets

#: Similarity in percent; the bounds below (4/5, 1/9) follow from it.
PERCENT = 80
RATIO = 1.6  # largest to smallest size in a band
CENTRES = 3  # checked per set before components are built
TILE = 1500  # members of a bucket compared in one block
TOP = 2  # largest buckets of an id that are looked at first
TWICE = 2  # rows of a signature that a batch sends to find out whether it is shared
FEW = 1 << 20  # ids that may be broadcast: some 30 MB
_SALT = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(None)
def bands() -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size of every band."""
    low, high = [], []
    at = 1
    while at < 1 << 40:
        low.append(at)
        high.append(max(at, int(at * RATIO)))
        at = high[-1] + 1
    return np.array(low), np.array(high)


def differing(size, high):
    """Most shingles in which a set may differ from a similar one of at most `high` shingles."""
    return (size + np.minimum(high, 5 * size // 4)) // 9


@lru_cache(None)
def plan(band: int) -> tuple[int, int, list[tuple[int, ...]]]:
    """(n1, n2, pieces left out by each choice) of a band: the fewest signatures for which
    sets with more empty parts than they have to spare are rare at every size."""
    low, high = (int(x[band]) for x in bands())
    k = 2 * high // 9
    if k == 0:
        return 1, 1, [()]
    best = None
    for k2 in range(1, min(k, 4) + 1):
        for n2 in range(k2 + 1, k2 + 5):
            choices = math.comb(n2, k2)
            needed = k // (k2 + 1) + 1
            for n1 in sorted({needed + int(needed * f / 50) for f in range(26)}):
                share = (n2 - k2) / (n1 * n2)
                rare = 0.0
                for size in {max(1, -(-4 * low // 5)), low, max(low, 4 * high // 5), high}:
                    mean = n1 * min(1.0, choices * (1 - share) ** size)
                    spare = n1 - int(differing(size, high)) // (k2 + 1) - 1
                    rare = max(rare, mean if spare == 0 else mean * math.exp(-max(0.0, spare - mean)))
                rank = (0, n1 * choices) if rare < 0.01 else (1, rare)
                if best is None or rank < best[0]:
                    best = rank, n1, n2, k2
                if rank[0] == 0:
                    break
    _, n1, n2, k2 = best
    return n1, n2, list(combinations(range(n2), k2))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of some sets (distinct 64-bit hashes each): positions and signatures."""
    low, high = bands()
    sizes = np.array([len(s) for s in sets])
    own = np.searchsorted(high, sizes)
    groups: dict[int, list[int]] = {}
    for i, band in enumerate(own.tolist()):
        if sizes[i]:
            groups.setdefault(band, []).append(i)
            if 5 * sizes[i] >= 4 * low[band + 1]:
                groups.setdefault(band + 1, []).append(i)
    at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for band, members in groups.items():
        n1, n2, choices = plan(band)
        shingles = np.concatenate([sets[i] for i in members])
        owner = np.repeat(np.arange(len(members)), sizes[members])
        part = (((shingles >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)).astype(np.int64)
        piece = ((shingles & np.uint64(0xFFFFFFFF)) % np.uint64(n2)).astype(np.int64)
        cell = (owner * n1 + part) * n2 + piece
        sums = np.zeros(len(members) * n1 * n2, np.uint64)
        np.add.at(sums, cell, mix(shingles ^ _SALT))
        counts = np.bincount(cell, minlength=len(sums)).reshape(-1, n1, n2)
        sums = sums.reshape(-1, n1, n2)
        left_out = np.array(choices, np.int64).reshape(len(choices), -1)
        held = counts.sum(2)[:, :, None] - counts[:, :, left_out].sum(3)
        hashed = sums.sum(2)[:, :, None] - sums[:, :, left_out].sum(3, dtype=np.uint64)
        name = mix(np.arange(n1 * len(choices), dtype=np.uint64) + np.uint64(band << 40))
        found = mix(mix(hashed) + held.astype(np.uint64) * _SALT + name.reshape(1, n1, -1))
        weak = (held == 0).any(2).sum(1)
        spare = n1 - differing(sizes[members], int(high[band])) // (len(choices[0]) + 1) - 1
        written_out = (held > 0) | (weak > spare)[:, None, None]
        at.append(np.repeat(members, written_out.sum((1, 2))))
        keys.append(found[written_out])
    return np.concatenate(at).astype(np.int64), np.concatenate(keys)


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle by hash, six or more bits a shingle and 2048 at least: the bitmaps
    of two sets differ in no more bits than the sets do in shingles. Short sets need many
    bits, since there a single change decides."""
    size = max(11, math.ceil(math.log2(6 * max(len(shingles), 1))))
    bits = np.zeros(1 << size, np.uint8)
    bits[(shingles >> np.uint64(64 - size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    one = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64)
    other = np.array([int(mix(s ^ _SALT).sum(dtype=np.uint64)) for s in sets], np.uint64)
    return mix(one ^ other).view(np.int64), other.view(np.int64)


def later(keys: np.ndarray, times: int) -> np.ndarray:
    """Which keys have occurred `times` times before, in order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[times:]] = ordered[times:] == ordered[: len(keys) - times]
    return out


@lean
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row (digest of its set, id, set size, second digest), and (signature, id, null or
    -1) for each of its signatures: -1 where the batch shows that it is shared. Sets already seen
    in this task sign only once."""
    seen: set[tuple[int, int]] = set()
    for batch in sliced(batches, "text", 1 << 20):
        sets = shingle_sets(batch.column("text"))
        n = np.array([len(s) for s in sets], np.int64)
        one, other = digests(sets)
        ids = batch.column("doc_id")
        yield pa.RecordBatch.from_arrays([pa.array(one), ids, pa.array(n), pa.array(other)], names=["sig", "id", "n", "h2"])
        new = []
        for i, digest in enumerate(zip(one.tolist(), other.tolist())):
            if n[i] and ids[i].is_valid and digest not in seen:
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(digest)
                new.append(i)
        at, keys = signatures([sets[i] for i in new])
        shared = later(keys, TWICE)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.view(np.int64)),
                ids.take(pa.array(np.array(new, np.int64)[at])),
                pa.array(np.full(len(keys), -1), mask=~shared),
                pa.nulls(len(keys), pa.int64()),
            ],
            names=["sig", "id", "n", "h2"],
        )


def sets_of(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, shingles) of the texts of the wanted ids."""

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            found = shingle_sets(batch.column("text"), size)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            values = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["id", "shingles"])

    some, _ = _chosen(docs, wanted)
    return some.mapInArrow(sets, "id long, shingles array<long>")


def bits_of(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, bits, n) of the texts of the wanted ids: bitmaps and sizes of their sets."""

    @lean
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            found = shingle_sets(batch.column("text"), size)
            columns = [pa.array([bitmap(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["id", "bits", "n"])

    some, few = _chosen(docs, wanted)
    if few:
        return some.mapInArrow(bits, "id long, bits binary, n long")
    every = docs.where("doc_id IS NOT NULL").mapInArrow(bits, "id long, bits binary, n long")
    return every.join(wanted, "id", "left_semi")  # bitmaps are shuffled, not texts


def _chosen(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, bool]:
    """Rows of `docs` with a wanted id, by broadcast if there are few ids, and whether so."""
    few = wanted.limit(FEW + 1).count() <= FEW
    wanted = wanted.withColumnRenamed("id", "doc_id")
    return docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi"), few


def _folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one length: neighbouring bits of longer ones merge."""
    out = np.empty((len(bitmaps), size), np.uint8)
    for i, b in enumerate(bitmaps):
        row = np.frombuffer(b, np.uint8)
        if len(row) > size:
            row = np.packbits(np.unpackbits(row).reshape(8 * size, -1).any(1))
        out[i] = row
    return out


def _near_pairs(rows: list[tuple], nearest: bool) -> set[tuple[int, int]]:
    """Pairs of one block that are in different components and may be similar; with `nearest`
    only the likeliest one for each row and those after it."""
    comp = np.array([r[3] for r in rows])
    n = np.array([r[5] for r in rows])
    side = np.array([r[6] for r in rows])
    size = min(len(r[4]) for r in rows)
    bits = _folded([r[4] for r in rows], size)
    found = set()
    for i in range(len(rows) - 1):
        ok = (comp[i + 1 :] != comp[i]) & (5 * np.minimum(n[i + 1 :], n[i]) >= 4 * np.maximum(n[i + 1 :], n[i]))
        ok &= (side[i + 1 :] != side[i]) | (side[i] == 0)
        at = np.flatnonzero(ok) + i + 1
        if len(at):
            apart = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
            likely = 9 * apart <= n[at] + n[i]
            at, apart = at[likely], apart[likely]
            for j in at[np.argsort(apart / (n[at] + n[i]), kind="stable")[:1]] if nearest else at:
                a, b = rows[i][0], rows[int(j)][0]
                if a != b:
                    found.add((min(a, b), max(a, b)))
    return found


def _block_pairs(batches: Iterator[pa.RecordBatch], nearest: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (id, sig, block, comp, bits, n, side), sorted by (sig, block); see `_cross`."""
    held: list[tuple] = []
    found: set[tuple[int, int]] = set()

    def out() -> pa.RecordBatch:
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if held and held[-1][1:3] != row[1:3]:
                found |= _near_pairs(held, nearest)
                held = []
                if len(found) > 50_000:
                    yield out()
            held.append(row)
    if held:
        found |= _near_pairs(held, nearest)
    yield out()


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (a, b, x, n, y, m) with two bitmaps and sizes those that may be similar."""
    for batch in batches:
        keep = []
        for x, n, y, m in zip(*(batch.column(c).to_pylist() for c in ("x", "n", "y", "m"))):
            ok = 5 * min(n, m) >= 4 * max(n, m)
            if ok:
                bits = _folded([x, y], min(len(x), len(y)))
                ok = 9 * int(np.bitwise_count(bits[0] ^ bits[1]).sum(dtype=np.int64)) <= n + m
            keep.append(ok)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps don't rule out."""
    both = pairs.join(bits.toDF("a", "x", "n"), "a").join(bits.toDF("b", "y", "m"), "b")
    return both.mapInArrow(_maybe, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of the written pairs (a, b) those whose sets are similar enough."""
    ids = written(pairs.select("a").union(pairs.select("b")).distinct().toDF("id"))
    found = sets(ids)
    both = pairs.join(found.toDF("b", "y"), "b").join(found.toDF("a", "x"), "a")
    shared = F.size(F.array_intersect("x", "y"))
    both = both.where(100 * shared >= PERCENT * (F.size("x") + F.size("y") - shared))
    return written(both.select("a", "b"))


def _cross(buckets: DataFrame, labels: DataFrame, bits: DataFrame, nearest: bool = False) -> DataFrame:
    """Pairs of one bucket that no link joins yet and that may be similar. With `nearest` a first
    choice of them, at most TOP for each id: its likeliest partner in its largest buckets.

    Members of one component need no comparing. So a large bucket is cut into tiles twice: the
    members of its most frequent component, and the rest. Blocks hold a tile of the former and
    one of the rest (sides 1 and 2, which only meet across), or one or two tiles of the rest.
    """
    rows = buckets.where("members > 2").select("sig", "id").join(labels, "id", "left")
    rows = rows.select("sig", "id", F.coalesce("component", "id").alias("comp"))
    sizes = rows.groupBy("sig", "comp").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("sig").agg(
        F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("comps")
    )
    tiles = sizes.where("comps > 1").select(
        "sig",
        "all",
        F.col("top.comp").alias("top"),
        (F.col("all") <= TILE).alias("small"),
        F.ceil(F.col("top.size") / TILE).cast("int").alias("tops"),
        F.ceil((F.col("all") - F.col("top.size")) / TILE).cast("int").alias("rests"),
    )
    rows = rows.join(written(tiles), "sig")
    if nearest:
        largest = Window.partitionBy("id").orderBy(F.desc("all"), "sig")  # an id has as many rows as signatures
        rows = rows.withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= TOP).drop("rank")
    rows = rows.withColumn("in_top", F.col("comp") == F.col("top"))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("in_top"), F.col("tops")).otherwise(F.col("rests"))).cast("long")
    rows = rows.withColumn("mine", mine)

    def block(i, j, across: bool, side):
        number = F.lit(int(across) << 60) + i * F.lit(1 << 30) + j
        return F.struct(number.alias("block"), side.alias("side"))

    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    here = F.col("mine")
    one, two = F.lit(1), F.lit(2)
    with_rest = F.transform(upto("rests"), lambda j: block(here, j.cast("long"), True, one))
    with_top = F.transform(upto("tops"), lambda i: block(i.cast("long"), here, True, two))
    side = lambda j: F.when(here == j, 0).when(here < j, 1).otherwise(2)
    among = F.transform(
        upto("rests"), lambda j: block(F.least(here, j.cast("long")), F.greatest(here, j.cast("long")), False, side(j))
    )
    alone = F.array(block(F.lit(-1).cast("long"), F.lit(0).cast("long"), False, F.lit(0)))
    places = F.when(F.col("small"), alone).when(F.col("in_top"), with_rest).otherwise(F.concat(with_top, among))
    rows = rows.join(bits, "id").select("id", "sig", F.inline(places), "comp", "bits", "n")
    rows = rows.select("id", "sig", "block", "comp", "bits", "n", "side")
    rows = rows.repartition("sig", "block").sortWithinPartitions("sig", "block")
    return rows.mapInArrow(partial(_block_pairs, nearest=nearest), "a long, b long").distinct()


def similar_pairs(
    shared: DataFrame, bits: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Links (a, b) that join the ids of `shared` (sig, id) exactly as all similar pairs with a
    common sig would. `bits(ids)` gives (id, bits, n) of the ids it gets, and
    `sets(ids)` gives (id, shingles). Both get written tables."""
    spark = shared.sparkSession
    groups = shared.groupBy("sig").agg(
        F.min("id").alias("centre"), F.max("id").alias("last"), F.count("*").alias("members")
    )
    groups = written(groups.where("centre <> last").drop("last"))
    buckets = written(shared.join(groups, "sig"))
    release(spark)
    bitmaps = written(bits(written(buckets.select("id").distinct())))
    release(spark)

    # Buckets of two are pairs, all of them checked here; larger ones have their say later.
    tried = buckets.where("id <> centre").groupBy("id", "centre")
    tried = tried.agg(F.count("*").alias("often"), F.min("members").alias("members"))
    best = Window.partitionBy("id").orderBy(F.desc("often"), "centre")
    tried = tried.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= CENTRES) | (F.col("members") == 2))
    tried = tried.select(F.col("centre").alias("a"), F.col("id").alias("b"))
    near = _verified(written(_possible(tried, bitmaps)), sets)
    # Large groups grow together through few pairs before all that is left is compared.
    for nearest in (True, False):
        labels = components(near)
        release(spark)
        near = near.union(_verified(written(_cross(buckets, labels, bitmaps, nearest)), sets))
    return near


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, copies.

    `copies` counts the rows with the same shingle set. Null, empty and blank texts
    have n_shingles 0 and are linked with nothing; rows without doc_id have no
    component. Rows that repeat a doc_id count as one document with several texts.
    Other columns of `docs` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    # One shuffle finds shared signatures. Rows known to be shared, and sets, are spread evenly.
    deal = F.when(F.col("n").isNull(), F.col("sig")).otherwise(F.xxhash64("id", "sig"))
    same = Window.partitionBy("deal", "sig")
    signed = docs.mapInArrow(_signed, "sig long, id long, n long, h2 long").withColumn("deal", deal).repartition("deal")
    signed = signed.withColumn("low", F.min("id").over(same)).withColumn("high", F.max("id").over(same))
    signed = written(signed.where("n IS NOT NULL OR low <> high").select("sig", "id", "n", "h2"))
    path = copies()[-1]
    release(spark)  # of all signatures only the shared ones are left
    plain = signed.where("n >= 0")
    equal = written(plain.groupBy("sig", "n", "h2").agg(F.min("id").alias("same"), F.count("*").alias("copies")))
    sets = written(
        plain.join(equal, ["sig", "n", "h2"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "same", "copies")
    )
    same_sets = sets.where("n_shingles > 0 AND doc_id <> same")
    links = same_sets.select(F.col("doc_id").alias("a"), F.col("same").alias("b"))

    first = same_sets.select(F.col("doc_id").alias("id"), "same").distinct()
    shared = signed.where("coalesce(n, -1) < 0").select("sig", "id").join(first, "id", "left")
    shared = written(shared.select("sig", F.coalesce("same", "id").alias("id")).distinct())
    drop_copies(spark, [path])
    near = similar_pairs(shared, lambda ids: bits_of(docs, ids), lambda ids: sets_of(docs, ids))
    labels = components(links.union(near)).toDF("doc_id", "component_id")

    out = sets.join(labels, "doc_id", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        "copies",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay: of each component the document of the smallest id.
    Rows without a doc_id stay."""
    labels = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(labels, "doc_id", "left_anti")
