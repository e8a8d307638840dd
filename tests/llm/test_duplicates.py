"""Exact dedup, n-gram join, repeated passages, against plain Python."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tablewright.llm import exact_dedup, minhash, ngram_join, paragraphs, words
from tablewright.llm.components import components

from .conftest import SCHEMA, jaccard_components, lower, odd_rows, prose, shingle_set


def exact_expected(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(lower(t), []).append(d)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def check_exact(df):
    got = df.collect()
    plain = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str)
    assert plain == exact_expected(odd_rows())
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_duplicates(odd):
    check_exact(exact_dedup.exact_duplicates(odd))


def test_texts_settle_what_a_weak_digest_leaves_open(odd):
    check_exact(exact_dedup.exact_duplicates(odd, digest=lambda sha: F.substring(F.hex(sha), 1, 1)))


def test_state_spans_many_batches(odd):
    check_exact(exact_dedup.exact_duplicates(odd, bytes_a_batch=1))


def test_kept_rows_have_all_columns(odd, nothing):
    kept = exact_dedup.last_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len({lower(t) for _, t, *_ in odd_rows()})
    assert exact_dedup.last_of_each(nothing).count() == exact_dedup.exact_duplicates(nothing).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(5, i) for i in range(1000, 1100)]
    loops = [(7, 7), (9, 8), (8, 9), (None, 3)]
    rng = random.Random(1)
    edges = [*path, *star, *loops]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in (5, *range(1000, 1100))}, 8: 8, 9: 8}


def test_jaccard_components(odd, nothing):
    rows = odd_rows()
    expected = jaccard_components([(d, t) for d, t, *_ in rows])
    got = ngram_join.jaccard_components(odd).collect()
    plain = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert plain == sorted(((d, len(shingle_set(t)), expected.get(d)) for d, t, *_ in rows), key=str)
    stays = ngram_join.one_of_each(odd)
    assert sorted(str(r.doc_id) for r in stays.collect()) == sorted(str(d) for d, *_ in rows if d is None or expected[d] == d)
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_links_across_components_and_tiles(spark, monkeypatch):
    """Graded copies of one text: few centres leave pieces that only the last check joins."""
    monkeypatch.setattr(ngram_join, "TILE", 7)
    monkeypatch.setattr(ngram_join, "CENTRES", 1)
    rng = random.Random(3)
    base = prose(rng, 60).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(60)] = f"y{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))
    assert {r.doc_id: r.component_id for r in got.collect()} == jaccard_components(rows)


def graded(rng, copies, near, others):
    """A third of all rows equal, as many nearly so, one line that all share, and unlike ones."""
    base, shared = prose(rng, 90, 5000), prose(rng, 12, 5000)
    rows = [f"{shared}\n{base}"] * copies
    for _ in range(near):
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(90)] = f"y{rng.randrange(9)}"
        rows.append(f"{shared}\n{' '.join(w)}")
    rows += [f"{shared}\n{prose(rng, rng.randrange(20, 90), 5000)}" for _ in range(others)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_hot_signatures(spark, monkeypatch):
    """Known to be shared within a batch, and tiles of a large component beside the rest."""
    monkeypatch.setattr(ngram_join, "TILE", 9)
    monkeypatch.setattr(ngram_join, "TWICE", 1)
    rows = graded(random.Random(12), 100, 100, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    five, four = jaccard_components(rows), jaccard_components(rows, 4)
    for _ in range(2):
        got = ngram_join.jaccard_components(df).collect()
        assert {r.doc_id: r.component_id for r in got} == five
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == four
        monkeypatch.setattr(ngram_join, "FEW", 3)  # the same without broadcasts


def test_later_keys():
    keys = np.array([5, 7, 5, 5, 7, 5, 9], np.uint64)
    assert ngram_join.later(keys, 2).tolist() == [False, False, False, True, False, True, False]
    assert ngram_join.later(keys[:1], 2).tolist() == [False]


def test_minhash_near_duplicates(odd, nothing):
    rows = odd_rows()
    expected = jaccard_components([(d, t) for d, t, *_ in rows], 4)
    got = minhash.near_duplicates(odd).collect()
    plain = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
    assert plain == sorted(
        ((d, len(shingle_set(t, 4)), expected.get(d), d is None or expected[d] == d) for d, t, *_ in rows), key=str
    )
    assert minhash.near_duplicates(nothing).count() == 0


def test_tensored_tables_have_the_recall():
    rng = np.random.default_rng(5)
    number = minhash.side(0.999)
    assert (1 - (1 - 0.8**minhash.ROWS) ** number) ** 2 >= 0.999 > (1 - (1 - 0.8**minhash.ROWS) ** (number - 1)) ** 2
    met, pairs = 0, 3000
    for _ in range(pairs):
        x = words.mix(rng.integers(1, 1 << 62, 90, dtype=np.uint64))
        keys = minhash.partial_keys([x[:81], x[9:]], 2 * number)  # 72 of 90 shared: 0.8 just
        equal = keys[0] == keys[1]
        met += bool(equal[:number].any() and equal[number:].any())
    assert met >= 0.997 * pairs


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rng.integers(1, 300))
        x = words.mix(rng.integers(1, 1 << 62, n, dtype=np.uint64))
        more = words.mix(rng.integers(1, 1 << 62, int(rng.integers(0, n // 5 + 2)), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(n) > rng.random() * 0.2], more]))
        x = np.unique(x)
        shared = len(np.intersect1d(x, y))
        if len(y) and 100 * shared >= 80 * (len(x) + len(y) - shared):
            assert len(np.intersect1d(ngram_join.signatures([x])[1], ngram_join.signatures([y])[1]))
            a, b = ngram_join.bitmap(x), ngram_join.bitmap(y)
            bits = ngram_join._folded([a, b], min(len(a), len(b)))
            assert 9 * int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(x) + len(y)


def test_shingles_count_like_plain_sets():
    texts = [t for _, t, *_ in odd_rows()]
    sets = words.shingle_sets(pa.array(texts, pa.string()))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    sliced = words.shingle_sets(pa.array(texts, pa.string()).slice(3, 9))
    assert [s.tolist() for s in sliced] == [s.tolist() for s in sets[3:12]]


def test_repeated_passages(spark, nothing):
    rng = random.Random(8)
    passages = [prose(rng, 55, 5000) for _ in range(12)]
    rows, planted = [], set()
    for i in range(120):
        lines = [prose(rng, rng.randrange(15, 80), 5000) for _ in range(4)]
        if i < 24:  # inside a longer line, twice each
            w = lines[1].split()
            at = rng.randrange(len(w))
            lines[1] = " ".join([*w[:at], passages[i // 2], *w[at:]])
            planted.add(i)
        rows.append((i, "\n".join(lines)))
    near = prose(rng, 60, 5000).split()
    other = [*near[:30], "changed", *near[31:]]
    rows += [(200, " ".join(near)), (201, "first\n" + " ".join(other)), (202, "the " * 90), (203, "the " * 95)]
    rows += [(204, None), (205, ""), (None, passages[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = paragraphs.repeated_passages(df.withColumn("sig", F.lit(0)).withColumn("words", F.lit("x"))).collect()
    assert {r.doc_id for r in got} == planted | {200, 201}
    by = {}
    for r in got:
        by.setdefault((r.kind, r.component), []).append(r)
    assert all(sum(r.kept for r in rs) == 1 and len({r.doc_id for r in rs}) > 1 for rs in by.values())
    assert all(r.kept == (r.doc_id == min(x.doc_id for x in rs)) for rs in by.values() for r in rs)
    text = {d: (t or "").split() for d, t in rows}
    for rs in by.values():
        if rs[0].kind == "passage":
            assert len({tuple(text[r.doc_id][r.first_word : r.first_word + r.n_words]) for r in rs}) == 1
    assert paragraphs.repeated_passages(nothing).count() == 0


def test_passages_in_short_lines(spark):
    """Word for word in lines of one to eight words, broken elsewhere, and nearly so."""
    rng = random.Random(9)
    wrap = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    rows, pairs = [], []
    for n in range(1, 9):
        passage = prose(rng, 60, 5000)
        for k in range(2):
            around = [prose(rng, 30, 5000) for _ in range(2)]
            rows.append((10 * n + k, "\n".join([around[0], wrap(passage, n), around[1]])))
        pairs += [10 * n, 10 * n + 1]
    broken = prose(rng, 60, 5000)
    rows += [(100, wrap(broken, 3)), (101, wrap(broken, 4)), (102, "one\ntwo\n\nthree"), (103, "one\ntwo\n\nthree")]
    near = wrap(prose(rng, 400, 5000), 8).split("\n")
    other = [*near[:20], near[20] + " more", *near[21:]]
    for d, lines in ((110, near), (111, other)):
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = paragraphs.repeated_passages(df).collect()
    assert {r.doc_id for r in got if r.kind == "passage"} >= {*pairs, 100, 101}
    assert {r.doc_id for r in got if r.kind == "paragraph"} >= {110, 111}
    assert {r.doc_id for r in got}.isdisjoint({102, 103})
    by = {}
    for r in got:
        by.setdefault((r.kind, r.component), []).append(r)
    assert all({r.doc_id for r in rs if r.kept} == {min(r.doc_id for r in rs)} for rs in by.values())


def test_paragraphs_cover_short_lines():
    rng = random.Random(10)
    texts = ["\n".join(prose(rng, rng.randrange(1, most), 900) for _ in range(40)) for most in (2, 4, 9, 19, 40)]
    alone = []
    for column in (pa.array(texts), *[pa.array([t]) for t in texts]):
        hashes, at, row = paragraphs.lines(column)
        first, ends = paragraphs.paragraphs(hashes, at, row)
        assert (ends - first >= paragraphs.LEAST_LINE).all()
        covered = np.zeros(len(hashes), bool)
        for a, b in zip(first, ends):
            covered[a:b] = True
        assert covered.all()
        alone.append(sorted(hashes[a:b].tolist() for a, b in zip(first, ends)))
    assert alone[0] == sorted(sum(alone[1:], []))


def test_bands_are_tuned_for_recall():
    bands, rows = paragraphs.tuned()
    assert 1 - (1 - paragraphs.SIMILARITY**rows) ** bands >= paragraphs.RECALL


def test_schema_of_odd_rows():
    assert len(odd_rows()[0]) == len(SCHEMA.split(","))
