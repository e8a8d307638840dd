"""Mixing, url filter, toxicity, licences, against plain Python."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import licences, mixing, toxicity, url_filter
from tablewright.llm.deobfuscate import Restorer, count_grams, log_probabilities

from .conftest import odd_rows, prose, words


def targets_of(sizes):
    """Shares given out by weight; what is over a limit is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_by_source(odd, nothing):
    rows = odd_rows()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    target = targets_of(sizes)
    got = mixing.mix_by_source(odd).collect()
    again = mixing.mix_by_source(odd.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    source = {d: s for d, _, _, s, _ in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    for s, t in target.items():
        assert any(math.isclose(r.target, t) and r.source_size == sizes[s] for r in got)
        assert abs(taken[s] - t) <= largest[s] + 1  # half a document for each of two copies
    assert mixing.mix_by_source(nothing).count() == mixing.mixed_rows(nothing).count() == 0


def test_small_sources_give_whole_documents(spark):
    """Three hundred sources of one document of a hundred words."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(100)), f"site{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_by_source(df).collect()
    assert all(r.taken in (0, 100, 200) and abs(r.taken - r.target) <= 50 for r in got) and len(got) == 300
    texts = {r[1] for r in rows}
    out = mixing.mixed_rows(df).collect()
    assert len(out) == sum(r.taken for r in got) // 100 and all(r.text in texts for r in out)


def test_documents_without_id_are_spread(spark):
    """They share no bucket, and reruns agree."""
    rows = [(None, f"w{i} and w{i + 1}", "s") for i in range(3000)] + [(None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(str(r.text) for r in mixing.mixed_rows(x).collect()) for x in (df, df.repartition(5))]
    assert got[0] == got[1] and len(got[0]) == 4500


def test_mixed_rows_have_the_words_taken(odd):
    taken = Counter()
    for r in mixing.mix_by_source(odd).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_rows(odd)
    assert out.columns == odd.columns
    whole = {}
    for d, t, *_ in odd_rows():
        whole.setdefault(d, set()).add(t)
    found = Counter()
    for r in out.collect():
        found[r.doc_id] += len(words(r.text))
        assert r.text in whole[r.doc_id] and r.n_chars in (None, len(r.text))
    assert found == +taken


def test_flow_fills_quotas_with_few_repeats():
    rng = random.Random(4)
    for _ in range(150):
        names = ["a", "b", "c"][: rng.randrange(1, 4)]
        patterns = [
            (list(m), rng.randrange(0, 9))
            for n in range(1, len(names) + 1)
            for m in itertools.combinations(names, n)
            if rng.random() < 0.7
        ]
        quotas = {s: rng.randrange(0, 15) for s in names}

        def most(copies):  # the smallest cut
            return min(
                sum(quotas[s] for s in side) + sum(copies * c for m, c in patterns if not set(m) <= set(side))
                for n in range(len(names) + 1)
                for side in itertools.combinations(names, n)
            )

        flows = mixing.route(patterns, quotas, 2)
        assert all(f <= c for used, (_, c) in zip(flows, patterns) for f in used)
        assert sum(map(sum, flows)) == most(2)
        assert sum(f[0] for f in flows) == most(1)


def test_overlapping_sources_and_too_many_patterns(spark):
    rows = [(i, 10, ["a", "b"] if i < 5 else ["b"]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, members array<string>")
    targets = spark.createDataFrame([("a", 50), ("b", 70)], "member string, target long")
    got = {r.doc_id: r.taken for r in mixing.mix(docs, targets).collect()}
    assert sum(got.values()) == 120 and all(got[i] >= 10 for i in range(10))
    with pytest.raises(ValueError):
        mixing.mix(docs, targets, max_patterns=1)


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?a=/es/#z", "https://m.example.com/en/1", "https://a.example.com/fr/2#x",
    "http://b.example.net/es/", "http://b.example.net/es", "http://net/fr/9", "http://xnet/fr/9", "http://c.example.org/de/3", "ftp://example.com",
    "http://example.com?x=/en/", "x://y://example.com/en/", "http://é.example.com/ü/" + "y" * 3000,
]


def plain_judgement(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = max(
        ((h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)),
        key=lambda r: len(r[0]), default=(None, None),
    )
    return host, path, *best


def plain_model(texts):
    """Counts of every context up to four characters, and Witten-Bell mixing."""
    grams = Counter()
    for t, n in texts:
        padded = "\x02" * 4 + t + "\x03"
        for i in range(4, len(padded)):
            for k in range(5):
                grams[padded[i - k : i + 1]] += n
    by = {}
    for g, n in grams.items():
        total, kinds = by.get((len(g), g[:-1]), (0, 0))
        by[len(g), g[:-1]] = total + n, kinds + 1

    def p(gram):
        below = 1 / 256 if len(gram) == 1 else p(gram[1:])
        total, kinds = by.get((len(gram), gram[:-1]), (0, 0))
        return (grams[gram] + kinds * below) / (total + kinds) if total else below

    return p


def learns(url):
    return zlib.crc32(url.encode()) % 5 != 0


@pytest.fixture(params=["broadcast", "salted"])
def model_join(request, monkeypatch):
    if request.param == "salted":
        monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 0)


def test_urls(spark, model_join):
    """Rules by host and path; scores of whole urls, whether they differ in query only or have no
    `://`; the threshold by urls that taught nothing; repeated and null page_id."""
    rng = random.Random(2)
    urls = URLS + ["x://a.example.org/q?" + c * 9 for c in "abc"] + ["mail to:" + c * 5 for c in "ab\U0001f600"] + [
        f"http://{rng.choice(['a', 'bb', 'm.c'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'fr', 'es'])}/{rng.randrange(90)}"
        + rng.choice(["", "?page=2", "?ref=x#top", "#top"])
        for _ in range(120)
    ]
    pages = [(i, u) for i, u in enumerate([*urls, *urls[:9]])]
    pages += [(None, urls[20]), (None, urls[20]), (3, urls[21])]
    frame = spark.createDataFrame([(i, u, "h", 0.5) for i, u in pages], "page_id long, url string, host string, score double")
    found = url_filter.judge(frame.repartition(4)).collect()
    got = sorted(found, key=lambda r: (str(r.page_id), r.host, r.path, r.score))
    plain = [(i, u or "", *plain_judgement(u)) for i, u in pages]
    accepted = plain_model(Counter(u for _, u, _, _, _, v in plain if v == "allow" and learns(u)).items())
    rejected = plain_model(Counter(u for _, u, _, _, _, v in plain if v == "block" and learns(u)).items())
    scores = {}
    for _, url, *_ in plain:
        padded = "\x02" * 4 + url + "\x03"
        ratios = [math.log(accepted(padded[j - 4 : j + 1])) - math.log(rejected(padded[j - 4 : j + 1])) for j in range(4, len(padded))]
        scores[url] = sum(ratios) / len(ratios)
    level = {u: max(-1000, min(1000, math.floor(abs(s) / 0.02 + 0.5) * (1 if s > 0 else -1))) for u, s in scores.items()}
    held = Counter((v, level[u]) for u, v in {u: v for _, u, _, _, _, v in plain if v and not learns(u)}.items())
    allow, block = (sum(n for (v, _), n in held.items() if v == kind) for kind in ("allow", "block"))
    assert allow and block

    def accuracy(cut):
        kept = sum(n for (v, k), n in held.items() if v == "allow" and k >= cut)
        out = sum(n for (v, k), n in held.items() if v == "block" and k < cut)
        return kept / allow + out / block

    cut = max(sorted({k for _, k in held}), key=accuracy)
    at = (cut - 0.5) * 0.02
    want = [(i, h, p, r, v or ("allow" if scores[u] >= at else "block"), scores[u]) for i, u, h, p, r, v in plain]
    want.sort(key=lambda r: (str(r[0]), r[1], r[2], r[5]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(g.score, w[5], abs_tol=1e-9) for g, w in zip(got, want))
    assert len({scores["x://a.example.org/q?" + c * 9] for c in "abc"}) == 3
    assert len({scores[u] for u in ("", "no scheme", "mail to:aaaaa")}) == 3
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_very_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.example.net/es/" + "ab" * 200_000), (2, "http://a.com/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages).collect()} == {1: "block", 2: "allow"}


def test_disguised_words_are_read():
    text = Counter({"stupid": 30, "idiot": 30, "loser": 30, "trash": 30, "good": 40, "the": 90, "people": 50, "is": 60, "on": 40})
    reader = Restorer(log_probabilities(count_grams(text)))
    for token, word in (
        ("stupid", "stupid"), ("5tup1d", "stupid"), ("$tupid", "stupid"), ("id10t", "idiot"), ("looooser", "loser"),
        ("stuuupid!!!", "stupid"), ("t.r.a.s.h", "trash"), ("l-o-s-e-r", "loser"), ("tr@sh", "trash"),
    ):
        assert word in reader.words(token), token
    assert reader.spaced("stupid") == ["stupid"]
    assert reader.words("12345") == [] and reader.words("") == [] and reader.words("!!!") == []
    assert reader.words("good,") == ["good"] and reader.words("the###") == ["the"]


def test_long_and_edge_disguises_are_read():
    text = Counter({"stupid": 30, "idiot": 30, "loser": 30, "trash": 30, "ass": 30, "shit": 30, "good": 40, "the": 90, "people": 50, "is": 60, "on": 40})
    reader = Restorer(log_probabilities(count_grams(text)))
    for token, word in (
        ("st" + "u" * 40 + "pid", "stupid"), ("the-good-people-5tup1d-the-good-people", "stupid"), ("the.good.people.the.good.people.2", "people"),
        ("455", "ass"), ("@$$", "ass"), ("5h17", "shit"), ("!diot", "idiot"), ("(good", "good"), ("good!", "good"),
    ):
        assert word in reader.words(token), token
    assert reader.words("good!") == ["good"] and reader.words("12345") == [] and reader.words("1" * 50) == []
    assert reader.spaced("stupid" * 30) == ["stupid"] * 30
    assert reader.spaced("stupidя5tupid") == ["stupid", "stupid"]


def test_viterbi_finds_the_best_of_all_readings():
    rng = random.Random(8)
    text = Counter({"stupid": 30, "idiot": 30, "loser": 9, "trash": 5, "good": 40, "the": 90, "people": 50, "letter": 20})
    reader = Restorer(log_probabilities(count_grams(text)))
    for _ in range(300):
        token = "".join(rng.choice("stupido13@!e") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randrange(1, 6)))
        lattice = reader.lattice(token, False)
        best = max(
            (
                (sum(c for _, c in way) + reader.likelihood("".join(s for s, _ in way)), "".join(s for s, _ in way))
                for way in itertools.product(*lattice)
            )
        )
        assert reader.likelihood(reader.viterbi(lattice)) <= 0
        found = max(
            sum(c for _, c in way) + reader.likelihood(reader.viterbi(lattice))
            for way in itertools.product(*lattice)
            if "".join(s for s, _ in way) == reader.viterbi(lattice)
        )
        assert math.isclose(found, best[0], abs_tol=1e-4)


def test_doubled_letters_are_read_once():
    text = Counter({"stupid": 30, "idiot": 30, "loser": 9, "good": 40, "the": 90, "people": 50, "letter": 20})
    reader = Restorer(log_probabilities(count_grams(text)))
    for token, word in (("stuupid", "stupid"), ("iidiot", "idiot"), ("ssttupid", "stupid"), ("looser!", "loser")):
        assert word in reader.words(token), token
    assert reader.words("good") == ["good"] and reader.words("letter") == ["letter"] and reader.words("the") == ["the"]
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("stupidoge") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(2, 7)))
        if not any(a == b == c for a, b, c in zip(word, word[1:], word[2:])):
            assert set(reader.undoubled(word)) == {word, reader.viterbi(reader.lattice(word, False))}


def toxic_rows():
    rng = random.Random(6)
    bad = ["stupid", "idiot", "loser", "trash"]
    disguise = [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0").replace("a", "4"), " ".join, lambda w: w[:2] + w[1] * 3 + w[2:]]
    rows, labels = [], []
    letters = "bcdfglmnprstvz"
    vocabulary = ["".join(rng.choice(letters) + rng.choice("aeou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    for i in range(500):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                word = rng.choice(bad)
                w.insert(rng.randrange(len(w)), rng.choice(disguise)(word) if rng.random() < 0.4 else word)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, odd, nothing):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "", "", 0)], "doc_id long, text string, lang string, source string, score long")
    marks = spark.createDataFrame([*labels, (900, None), (5000, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == 502 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    right = [got[d].predicted == y for d, y in labels if got[d].held_out]
    assert sum(right) / len(right) >= 0.95
    kept = toxicity.clean(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}
    assert toxicity.toxicity(nothing, marks).count() == 0
    assert all(r.score < 1e-6 for r in toxicity.toxicity(odd, marks.limit(0)).collect())


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    other = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    a, b = (
        {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()}
        for x in (labels, other)
    )
    assert a == b


def test_licences(spark, nothing):
    rng = random.Random(9)
    noise = "\n".join(prose(rng, 12) for _ in range(3))
    cases = {
        "Apache": "licensed under the Apache License, version 2.0", "MIT": "It is Released under the MIT License.",
        "GPL": "distributed under GNU General Public License, version 2", "CC-NC": "Licensed under CC BY-NC 4.0.", "Proprietary": "All rights reserved.",
    }
    clean = ["a licensed driver asked permission to go", "He had all rights and reserved a table", "", None, "license " * 500]
    rows = [(i, f"{noise}\n{t}\n{noise}") for i, t in enumerate(cases.values())]
    rows += [(100 + i, t if t is None else f"{noise}\n{t}") for i, t in enumerate(clean)]
    rows += [(200, prose(rng, 5000) + " " + cases["GPL"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("x"))
    got = licences.licences(df).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got} == {(i, 3, f) for i, f in enumerate(cases)} | {(200, 0, "GPL")}
    assert all(r.probability >= licences.CONFIDENT and r.shared >= licences.SHARED for r in got)
    assert licences.licences(nothing).count() == 0


def test_wrapped_and_several_licences(spark):
    rng = random.Random(11)
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:"
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software\nwithout restriction."
    dual = "Released under the MIT License. " + prose(rng, 60) + " This work is licensed under the GNU General Public License, version 3."
    rows = [(0, f"#\n{bsd}\n#"), (1, mit), (2, dual), (3, "Licensed under\nCC BY-NC 4.0."), (4, f"{prose(rng, 12)}\n\n{prose(rng, 9)}")]
    rows += [(10 + i, prose(rng, 30)) for i in range(60)]
    got = licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(0, 1, "BSD"), (1, 0, "MIT"), (2, 0, "GPL"), (2, 0, "MIT"), (3, 0, "CC-NC")]


#: Wordings used while templates and the fit were chosen, so no held-out measure; some contain a template.
WORDINGS = [
    ("LGPL", "you can modify this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LGPL", "Foo is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL", "You should have received a copy of the GNU Affero General Public License along with this server."),
    ("AGPL", "The service is licensed under the GNU Affero General Public License, version 3 or later"),
    ("GPL", "you may redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version"),
    ("GPL", "The driver is licensed under the GNU General Public License, version 2"),
    ("MPL", "The file is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was lost"),
    ("MPL", "Foo is licensed under the Mozilla Public License, version 1.1"),
    ("ISC", "Permission to use, copy, modify, and distribute this program for any purpose with or without fee is hereby granted"),
    ("ISC", "Foo is released under the ISC license by its authors"),
    ("CC0", "to the extent possible under law, the person has waived all copyright and related rights to this text"),
    ("CC0", "The data are dedicated to the public domain under CC0 1.0 Universal."),
    ("Apache", "Foo is available under Apache 2.0 since May"),
    ("Apache", "Foo is licensed under the Apache License, Version 2.0, see the file"),
    ("MIT", "Foo is released under the MIT License, see the file"),
    ("MIT", "Foo is licensed under the terms of the MIT license"),
    ("BSD", "Foo is released under the BSD 2-Clause License"),
    ("CC-BY", "The photograph is licensed under a Creative Commons Attribution 3.0 International License."),
    ("CC-NC", "The poem is licensed under a Creative Commons Attribution-NonCommercial 3.0 International License."),
    ("Proprietary", "Copyright 1999 The Foo Company, all rights reserved"),
]
ORDINARY = [
    "all rights reserved for members were debated", "the club has all rights reserved for its oldest members",
    "she asked for permission to use the copy of the book", "the license of the driver was released under protest",
    "the general public may use the library with a license", "the Apache chief signed version 2 of the treaty",
    "MIT students are licensed to sail", "copyright law is a part of the course", "the GNU project began in 1983",
    "you may obtain a copy of the key at the desk", "no part of the house may be sold without permission",
    "the creative commons of the village are open", "he waived all rights to the estate", "a licence was granted to the inn",
    "to the extent possible under law, the council has answered", "Released under the zlib License.", "SPDX-License-Identifier: Zlib",
    "the above notice was included in all papers", "the isc of the county is a public body", "this software is free of charge for any person",
]


def test_other_wordings_and_ordinary_sentences(spark):
    """Precision and recall of families on other wordings, among ordinary sentences."""
    rng = random.Random(13)
    rows = [(i, f"{prose(rng, 12)}\n\n{t}\n\n{prose(rng, 12)}") for i, (_, t) in enumerate(WORDINGS)]
    rows += [(100 + i, f"{prose(rng, 12)}\n\n{t}\n\n{prose(rng, 12)}") for i, t in enumerate(ORDINARY)]
    rows += [(1000 + i, prose(rng, 30)) for i in range(200)] + [rows[0]]
    got = licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found, want = {(r.doc_id, r.family) for r in got}, {(i, f) for i, (f, _) in enumerate(WORDINGS)}
    right = len(found & want)
    assert right / len(want) >= 0.9 and right / len(found) >= 0.9, (sorted(want - found), sorted(found - want))
    assert len([r for r in got if r.doc_id == 0]) == 2 * len([f for i, f in found if i == 0])  # repeated rows


def test_confirmed_licences_have_a_needed_word():
    needed = set(licences._needed_words())
    for template in (licences.words_of(t) for ts in licences.TEMPLATES.values() for t in ts):
        pairs = list(zip(template, template[1:]))
        assert sum(not needed & set(p) for p in pairs) < licences.SHARED * len(pairs)


def test_logistic_regression_separates():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 20)
    w = toxicity.fit(x, (x[:, 0] > 1.5).astype(float))
    assert list((x[:4] @ w[:-1] + w[-1]) > 0) == [False, False, True, True]
