"""Token files, fingerprints, packing, and the pipeline as a whole."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.functions.storage import scratch_path
from tablewright.llm import fingerprints, packing, repair
from tablewright.llm.tables import lean
from tablewright.llm.tokens import Words, words_of
from tablewright.llm.words import word_hashes

from .conftest import jaccard_components, lower, odd_rows, words

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
def test_words_make_the_library_s_ids(path, spaced):
    rng = random.Random(1)
    odd = ["", " ", "  a", "a  b", "a\n b", "a \nb", " a", "a ", "don't we'll", "x<|endoftext|>y", "a.b,c\nd", "é.à b", "a\x1cb \x85c\xa0 \xa0d", "İ ß ﬁ ΑΣ"]
    odd += ["<|endoftext|>", "a <|endoftext|> b", "a <|ENDOFTEXT|> b", "<|startoftext|>c", "a <| b", None, "a" * 500, "a.b " * 99]
    odd += ["Za.\nB c,\n d.\n", "a.\n\nb", "a.b.c", "a\u2003 b", "a \u2003b", "a “b” c", "x.,y", "\n.a", "Ａ.b", "a\0b"]
    odd += ["".join(rng.choice("abZ .,\n'1é \t\xa0\x1f“\u3000<|") for _ in range(rng.randrange(30))) for _ in range(6000)]
    table, one = Words(path, spaced), library(path)
    for start in range(0, len(odd), 500):
        part = odd[start : start + 500]
        assert table.ids(pa.array(part, pa.string())) == [one(t)[:-1].tobytes() for t in part]


def test_tables_forget_words_but_not_their_ids():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) + str(i) for _ in range(9)) for i in range(200)]
    table, one = Words(BYTES, True, limit=1 << 15), library(BYTES)
    most = 0
    for t in texts:
        assert table.ids(pa.array([t])) == [one(t)[:-1].tobytes()]
        most = max(most, table.table.count)
    assert 0 < table.table.count < most


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """Hashes of three bits: most words share one with another."""
    weak = lambda raw, starts, ends, lower: np.uint64(1) + (word_hashes(raw, starts, ends, lower) >> np.uint64(61))
    monkeypatch.setattr("tablewright.llm.tokens.word_hashes", weak)
    texts = [f"w{i} w{i % 7} same, other" for i in range(60)]
    table, one = Words(WORDS, False), library(WORDS)
    assert table.ids(pa.array(texts)) == [one(t)[:-1].tobytes() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 12), max_size=60), min_size=1, max_size=20), st.integers(0, 2**32))
def test_shards_round_trip(docs, seed):
    rng = random.Random(seed)
    docs = [[*d * rng.randrange(1, 9), 0] for d in docs]
    ids = np.array([x for d in docs for x in d], "<u4")
    ends = np.cumsum([len(d) for d in docs])
    shard = repair.from_bytes(repair.to_bytes(repair.compress(ids, ends)))
    decoder = repair.Decoder(shard)
    assert decoder.expand(shard.sequence).tolist() == ids.tolist()
    for k, d in enumerate(docs):
        low = rng.randrange(len(d))
        high = rng.randrange(low, len(d) + 1)
        assert decoder.document(k).tolist() == d and decoder.document(k, low, high).tolist() == d[low:high]


def test_long_repeats_become_few_symbols():
    block = np.arange(1, 513)
    ids, ends = np.tile(block, 100).astype("<u4"), 512 * np.arange(1, 101)
    shard = repair.compress(ids, ends)
    assert len(shard.sequence) <= 200
    assert repair.Decoder(shard).expand(shard.sequence).tolist() == ids.tolist()


def test_ids_from_files(spark, odd, nothing):
    path = scratch_path(spark, "ids")
    repair.write_ids(odd, path, BYTES, shard=500)
    got = sorted(map(tuple, repair.read_ids(spark, path).collect()), key=lambda r: r[1])
    one, at, expected = library(BYTES), 0, []
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for d, t, *_ in rows:
        ids = one(t)
        expected.append((d, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert got == expected
    path = scratch_path(spark, "ids")
    repair.write_ids(nothing, path, BYTES)
    assert repair.read_ids(spark, path).count() == 0


def phrases(data):
    seen, now = set(), b""
    for i in range(len(data)):
        now += data[i : i + 1]
        if now not in seen:
            seen.add(now)
            now = b""
    return seen


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=60), st.text("abé", max_size=60))
def test_parses_are_lempel_ziv(text, following):
    edited, kept = fingerprints.edit(text, following)
    half = len(text) // 2
    assert edited == text[: len(text) - half] + following[:half]
    a, b = fingerprints.both_fingerprints(text, edited, kept)
    assert (a == fingerprints.signature(phrases(text.encode()))).all()
    assert (b == fingerprints.signature(phrases(edited.encode()))).all()


def test_fingerprints(spark, odd, nothing):
    rows = sorted(odd_rows(), key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    got = fingerprints.lz_fingerprints(odd).collect()
    assert len(got) == len(rows)
    unique = [r for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1]
    by = {r.doc_id: r for r in got}
    for i, (d, t, *_) in enumerate(rows[:-1]):
        if (d, t) not in {u[:2] for u in unique} or rows[i + 1][0] is None:
            continue
        t, following = t or "", rows[i + 1][1] or ""
        edited, _ = fingerprints.edit(t, following)
        r = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        prints = [fingerprints.signature(phrases(x.encode())) for x in (t, edited, following)]
        assert r.fingerprint == fingerprints._hex(prints[0]) and r.edited_fingerprint == fingerprints._hex(prints[1])
        assert r.near_edited == fingerprints.likeness(prints[0], prints[1])
        assert r.near_next == fingerprints.likeness(prints[0], prints[2])
    alone = fingerprints.lz_fingerprints(spark.createDataFrame([(1, "abab")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.lz_fingerprints(nothing).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_bounds_and_best_fit(lengths):
    size = 20
    x = np.array(lengths, np.int64)
    least = optimum(sorted(lengths, reverse=True), size)
    assert packing.lower_bound(x, size) <= least
    if lengths:
        bins, places = packing.best_fit(x, size)
        check_gapless(zip(bins.tolist(), places.tolist(), lengths), size)
        assert least <= bins.max() + 1 <= 2 * least


def optimum(lengths, size):
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best[0]


def check_gapless(rows, size):
    by = defaultdict(list)
    for number, place, length in rows:
        by[number].append((place, length))
    for parts in by.values():
        at = 0
        for place, length in sorted(parts):
            assert place == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("group", [12, packing.GROUP])
def test_packing(odd, nothing, group):
    got = packing.pack(packing.piece_rows(odd, WORDS), group=group).collect()
    one, expected = library(WORDS), []
    for d, t, *_ in odd_rows():
        ids = one(t)
        expected += [(d, i, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048])) for i, k in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    used = check_gapless(((r.sequence_id, r.offset, r.length) for r in got), 2048)
    least = packing.lower_bound(np.array([e[3] for e in expected]), 2048)
    assert used <= (least + 1 if group > len(expected) else 1.1 * least)  # small partitions see little of each other
    assert packing.pack(packing.piece_rows(nothing, WORDS)).count() == 0


def short_texts(spark):
    """400 documents of 1 to 400 words, which make a piece each."""
    return spark.range(400).selectExpr("id AS doc_id", "repeat('word ', int(id) + 1) AS text")


def check_many_partitions(got, docs):
    """More partitions than an int's bits have room for, and all pieces in sequences of their own."""
    one = library(WORDS)
    lengths = {r.doc_id: len(one(r.text)) for r in docs.collect()}
    assert sorted((r.doc_id, r.length) for r in got) == sorted(lengths.items())
    check_gapless(((r.sequence_id, r.offset, r.length) for r in got), 2048)
    assert min(r.sequence_id for r in got) >= 0
    assert max(r.sequence_id >> 26 & (1 << 26) - 1 for r in got) >= 32


def test_pipeline_packs_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "pack", partial(packing.pack, group=4))
    docs, path = short_texts(spark), scratch_path(spark, "stage")
    dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").write.parquet(path)
    check_many_partitions(spark.read.parquet(path).collect(), docs)


@pytest.mark.parametrize("group", [2, 9])
def test_sequence_ids_have_room_for_many_partitions(spark, group):
    docs = short_texts(spark)
    got = packing.pack(packing.piece_rows(docs.repartition(3), WORDS), group=group).collect()
    check_many_partitions(got, docs)


def test_pipeline(spark):
    """Every stage's decisions on what the one before kept, by plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append([r.asDict() for r in docs.collect()])
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    assert all(set(rows[0]) == columns for rows in kept[:4])
    clean, single, apart, mixed, packed = kept
    last = {}
    for r in clean:
        last[lower(r["text"])] = max(last.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in single) == sorted(last.values())
    smallest = jaccard_components([(r["doc_id"], r["text"]) for r in single])
    assert sorted(r["doc_id"] for r in apart) == sorted(d for d, low in smallest.items() if d == low)
    texts = {r["doc_id"]: r["text"] for r in apart}
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed)  # whole documents
    largest = defaultdict(int)
    for r in apart:
        largest[r["source"]] = max(largest[r["source"]], len(words(r["text"])))
    total = sum(len(words(t)) for t in texts.values())
    assert abs(sum(len(words(r["text"])) for r in mixed) - 1.5 * total) <= sum(largest.values())
    one = library(WORDS)
    assert sum(r["length"] for r in packed) == sum(len(one(r["text"])) for r in mixed)
    check_gapless(((r["sequence_id"], r["offset"], r["length"]) for r in packed), 2048)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_send_small_batches_to_python(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefgh', 512) AS text")  # 12 MB in a task
        sized = corpus_pipeline.stage(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "bytes long"))
        assert max(r["bytes"] for r in sized(spark, docs, "").collect()) < 5 << 20
        spark.conf.set(key, str(8 << 20))  # a size of the session's own stays
        assert 5 << 20 < max(r["bytes"] for r in sized(spark, docs, "").collect()) < 9 << 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_other_work_drops_the_words_of_tokenizing():
    words_of(WORDS, False)
    list(partial(lean, tokens=True)(lambda batches: batches)(iter([1])))
    assert words_of.cache_info().currsize == 1
    assert list(lean(lambda batches: batches)(iter([1]))) == [1]
    assert words_of.cache_info().currsize == 0
