"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines, and runs of lines that are not blank, since notices are often
wrapped. They are described by hashed word one- to three-grams. One logistic
regression per licence family is trained on variants of the family's templates against
the other families, ordinary paragraphs of the corpus, and near misses: notices of licences
without a family, sentences with licence words, and paragraphs of the corpus with such words that
no template resembles. Probabilities are calibrated on what a model has not seen: half of the
variants, and half of the near misses and other paragraphs with all that was made of them, in turn.
Templates are not kept out, since only what resembles a known one can be confirmed.
A paragraph whose best calibrated probability is under `CONFIDENT` is of the unknown class. What remains must also share
enough pairs of neighbouring words with a template of that family. Every place that does is
a statement; of families that claim the same words, the most probable one has them.

Templates are short public notices by which works state their licence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import sliced

#: Notices as licences or their stewards word them.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "Available under Apache 2.0.",
        "Released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "This code is MIT licensed.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL version 3.",
        "Distributed under the terms of the GNU GPL v3.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL version 3.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Released under the AGPL version 3.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Available under the MPL 2.0.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "This project is licensed under the terms of the ISC license.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "Licensed under CC0 1.0.",
        "Creative Commons Zero v1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "This project is licensed under the terms of the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Available under a Creative Commons Attribution-NonCommercial license; additional terms may apply.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Corporation. All rights reserved.",
        "Copyright 2020 by the author, all rights reserved worldwide.",
        "All content on this site is copyright of its owner. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without prior written permission.",
    ],
}
FAMILIES = tuple(TEMPLATES)
#: Of no family: other licences, and sentences that only use the words of notices.
NEAR_MISSES = [
    "Released under the zlib License.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Artistic-2.0",
    "Licensed under the Eclipse Public License, version 2.0.",
    "This work is licensed under the Artistic License, version 2.0.",
    "Released under the Boost Software License.",
    "The museum keeps all rights reserved for its members until spring.",
    "All rights reserved to the buyer were listed in the contract of sale.",
    "They asked whether all rights reserved by the treaty had been honoured.",
    "Seats with all rights reserved for guests of the hotel are near the window.",
    "He lost his driving license under the new law and was released under bail.",
    "The board may grant a license to sell food free of charge to any person in the market.",
    "Permission is hereby asked, not granted, to leave the room.",
    "The Apache helicopter landed under version 2.0 of the flight plan.",
    "The Apache nation was licensed by no one to sell the land.",
    "Students at MIT need a license to keep a car on the campus.",
    "The MIT professor was released under the terms of an agreement.",
    "The copyright of the song belongs to the singer and no part of it was ever sold.",
    "No part of this journey may be repeated without a good map.",
    "The general public had to pay for a license, version after version.",
    "A gnu grazed near the general store where the public bought a fishing license.",
    "Creative people in the commons gave their work away.",
    "You may obtain a copy of the menu at the counter.",
    "You should have received a copy of the letter along with this parcel.",
    "To the extent possible under law, the author of the report answered all questions.",
    "The work is dedicated to the public and the domain of art.",
    "Use of this road is governed by a law that can be found in the town hall.",
    "Redistribution of wealth and use of force were, with or without reason, the topics of the evening.",
    "If a copy of the key was not left with this note, you can obtain one at the desk.",
    "The above notice shall be included in all letters of the office.",
    "The new version of the software is free, and you can change it later.",
    "The fee is hereby waived, provided that the form is sent in all copies.",
]
BITS = 14
CONFIDENT = 0.7
SHARED = 0.6  # of a template's pairs of neighbouring words
VARIANTS = 60  # made of each template
BACKGROUND = 4000  # ordinary paragraphs learned from, drawn by hash
LEARNED = 400  # characters of a drawn line; what bounds the fit, not the scan
AROUND = 5  # words before and after a place that are judged with it
LONGEST = 40  # words of a paragraph looked at together; longer ones are looked at in overlapping pieces
_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
#: Comment marks and blanks; a line of nothing else ends a paragraph.
_MARKS = " \t\r\f\v#*/;%!<>|-"
#: Words of notices; paragraphs with any are learned from only if no template is like them.
_NEEDED = re.compile(
    r"licen[cs]e|licensed|copyright|permission|permitted|rights reserved|creative commons|redistribut|cc by|spdx|apache|gnu|cc0|mozilla|\bmpl\b|gpl", re.I
)


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _needed_words() -> list[str]:
    """Words of which every confirmed paragraph has one: of each template, the pairs without any
    of them are too few to be the share that confirms."""
    chosen: set[str] = set()
    for template in (words_of(t) for ts in TEMPLATES.values() for t in ts):
        pairs = list(zip(template, template[1:]))
        for word in sorted(set(template), key=lambda w: (-len(w), w)):
            if sum(not chosen & set(p) for p in pairs) < SHARED * len(pairs):
                break
            chosen.add(word)
    return sorted(chosen)


_CAN = re.compile("|".join(map(re.escape, _needed_words())))
_PAIRS = {p for ts in TEMPLATES.values() for t in ts for p in zip(words_of(t), words_of(t)[1:])}
_LEAST_PAIRS = min(ceil(SHARED * (len(words_of(t)) - 1)) for ts in TEMPLATES.values() for t in ts)


_WORDS = {f: [words_of(t) for t in ts] for f, ts in TEMPLATES.items()}


def features(words: list[str]) -> np.ndarray:
    """Hashed one- to three-grams."""
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return np.unique(np.array([zlib.crc32(g.encode()) & ((1 << BITS) - 1) for g in grams], np.int64))


def _variants(template: str, background: list[list[str]], rng: np.random.Generator, most_lost: float = 0.3) -> list[list[str]]:
    """The text with other numbers, up to `most_lost` of its words lost, and ordinary words around it."""
    words, out = words_of(template), [words_of(template)]
    for _ in range(VARIANTS):
        lost = most_lost * rng.random()
        some = [w for w in words if rng.random() > lost]
        some = [_other_number(w, rng) if w[0].isdigit() and rng.random() < 0.5 else w for w in some]
        other = background[rng.integers(len(background))] if background else []
        cut = int(rng.integers(0, AROUND + 1))
        before, after = other[:cut], other[cut : cut + int(rng.integers(0, AROUND + 1))]
        out.append([*before, *some, *after] if some and (not most_lost or _nearest(some) in (None, _family(template))) else words)
    return out


def _other_number(word: str, rng: np.random.Generator) -> str:
    """A version or a year of the same form."""
    if len(word) == 4 and word.isdigit():
        return str(rng.integers(1980, 2030))
    return str(rng.integers(1, 10)) + (f".{rng.integers(0, 3)}" if "." in word else "")


def _family(template: str) -> str | None:
    return next((f for f in FAMILIES if template in TEMPLATES[f]), None)


def _nearest(words: list[str]) -> str | None:
    """The family whose template shares most with the words; None where no template confirms. Words
    lost can turn one family's notice into another's, which is then no example of the first."""
    share, family = max((_shared(t, words), f) for f, ts in _WORDS.items() for t in ts)
    return family if share >= SHARED else None


def _regress(rows: list[np.ndarray], y: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression per column of y, by accelerated gradient steps. Every row has features."""
    lengths = np.array([len(r) for r in rows])
    cell, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(cell, kind="stable")
    used, firsts = np.unique(cell[order], return_index=True)
    scale = 1 / np.sqrt(lengths)[:, None]
    w, b = np.zeros((1 << BITS, y.shape[1])), np.zeros(y.shape[1])
    momentum, step = np.zeros_like(w), 8.0
    for _ in range(rounds):
        z = np.add.reduceat(w[cell], starts)
        p = 1 / (1 + np.exp(-np.clip(z * scale + b, -30, 30)))
        slope = ridge * w
        slope[used] += np.add.reduceat(((p - y) * scale)[owner[order]], firsts) / len(rows)
        momentum = 0.9 * momentum - step * slope
        w, b = w + momentum, b - step * (p - y).mean(0)
    return w, b


class Classifier:
    def __init__(self, weights: np.ndarray, constant: np.ndarray, calibration: np.ndarray):
        self.weights, self.constant, self.calibration = weights, constant, calibration
        self.templates = {f: [words_of(t) for t in TEMPLATES[f]] for f in FAMILIES}

    def margins(self, words: list[str]) -> np.ndarray:
        at = features(words)
        return self.weights[at].sum(0) / np.sqrt(max(len(at), 1)) + self.constant

    def judge(self, words: list[str]) -> list[tuple[str, float, float, int, int]]:
        """(family, probability, share of the template's pairs, first word, end) of all statements."""
        near = [(k, t, share) for k, f in enumerate(FAMILIES) for t in self.templates[f] if (share := _shared(t, words)) >= SHARED]
        if not near:
            return []
        found = []
        for k, t, share in near:
            for first, end in _places(t, words):
                p = self.probabilities(words[max(0, first - AROUND) : end + AROUND])[k]
                if p >= CONFIDENT:
                    found.append((FAMILIES[k], float(p), share, first, end))
        return found

    def probabilities(self, words: list[str]) -> np.ndarray:
        slope, shift = self.calibration
        return 1 / (1 + np.exp(-np.clip(slope * self.margins(words) + shift, -30, 30)))


def _places(template: list[str], words: list[str]) -> list[tuple[int, int]]:
    """Where the template stands in words that share enough with it: the densest place, and
    others that share enough by themselves."""
    pairs = list(zip(template, template[1:]))
    wanted, reach = set(pairs), len(template) * 3 // 2
    found = []

    def search(at: list[int], least: float) -> None:
        best = None
        for i, first in enumerate(at):
            inside = [j for j in at[i:] if j < first + reach]
            have = {(words[j], words[j + 1]) for j in inside}
            share = sum(p in have for p in pairs) / len(pairs)
            size = inside[-1] + 2 - first
            if share >= least and (best is None or (share, -size) > best[:2]):
                best = share, -size, first, first + size
        if best:
            found.append(best[2:])
            search([j for j in at if j + 1 < best[2]], SHARED)
            search([j for j in at if j >= best[3]], SHARED)

    search([j for j, p in enumerate(zip(words, words[1:])) if p in wanted], 0.0)
    return found


def _shared(template: list[str], words: list[str]) -> float:
    """Share of the template's pairs of neighbouring words that the paragraph has."""
    have = set(zip(words, words[1:]))
    pairs = list(zip(template, template[1:]))
    return sum(p in have for p in pairs) / len(pairs)


def _resembles(words: list[str]) -> bool:
    """Whether half of what confirms a template is there: such a paragraph may be a notice."""
    return any(_shared(words_of(t), words) >= SHARED / 2 for ts in TEMPLATES.values() for t in ts)


def train(background: list[str], seed: int = 7) -> Classifier:
    """Learn from variants of the templates, near misses and ordinary paragraphs."""
    rng = np.random.default_rng(seed)
    pieces = [(w, b) for b in background for w in [words_of(b)] if w]
    plain = [w[at : at + LONGEST] for w, b in pieces if not _NEEDED.search(b) for at in range(0, len(w), LONGEST)]
    tempting = [w[at : at + LONGEST] for w, b in pieces if _NEEDED.search(b) for at in range(0, len(w), LONGEST)]
    plain += [w for w in tempting if not _resembles(w)]
    # (words, family or -1, fold): all variants of a near miss share a fold.
    rows = [
        (words, k, i % 2)
        for k, family in enumerate(FAMILIES) for t in TEMPLATES[family] for i, words in enumerate(_variants(t, plain, rng))
    ]
    rows += [(words, -1, i % 2) for i, t in enumerate(NEAR_MISSES) for words in _variants(t, plain, rng, 0.0)]
    rows += [(words, -1, int(rng.integers(2))) for words in plain]
    y = (np.array([k for _, k, _ in rows])[:, None] == np.arange(len(FAMILIES))).astype(float)
    cells, fold = [features(words) for words, _, _ in rows], np.array([f for *_, f in rows])
    margins = np.zeros_like(y)
    for f in (0, 1):
        half = Classifier(*_regress([c for c, g in zip(cells, fold) if g != f], y[fold != f]), np.array([1.0, 0.0]))
        margins[fold == f] = [half.margins(words) for words, _, g in rows if g == f]
    return Classifier(*_regress(cells, y), _calibrated(margins.ravel(), y.ravel()))


def _calibrated(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and shift that make margins probabilities (Platt's targets), by Newton's method."""
    positive = y.sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
    return w


def paragraphs(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """(words, line number of each) of the runs of lines that are not blank."""
    words: list[str] = []
    of: list[int] = []
    for number, line in enumerate(text.split("\n")):
        if not line.strip(_MARKS):
            if words:
                yield words, of
            words, of = [], []
            continue
        more = words_of(line)
        words += more
        of += [number] * len(more)
    if words:
        yield words, of


def windows(of: list[int]) -> Iterator[tuple[int, int]]:
    """First words and ends of the pieces looked at: of each line, and of the whole run."""
    starts = [i for i in range(len(of)) if not i or of[i] != of[i - 1]]
    spans = dict.fromkeys([*zip(starts, [*starts[1:], len(of)]), (0, len(of))])
    for first, end in spans:
        for at in range(first, max(first + 1, end - LONGEST // 2), LONGEST // 2):
            yield at, min(at + LONGEST, end)


def merged(hits: list[tuple[str, float, float, int, int]]) -> list[tuple[str, float, float, int, int]]:
    """Overlapping hits of one family as one; of different families, a hit that lies in a more
    probable one for more than half of its words is left out. Probabilities that agree to two
    digits leave the choice to the share of the template."""
    one: list[tuple[str, float, float, int, int]] = []
    for family, p, share, first, end in sorted(hits, key=lambda h: (h[0], h[3], h[4])):
        if one and one[-1][0] == family and first < one[-1][4]:
            _, p0, share0, first0, end0 = one[-1]
            one[-1] = family, max(p, p0), max(share, share0), first0, max(end, end0)
        else:
            one.append((family, p, share, first, end))
    kept: list[tuple[str, float, float, int, int]] = []
    for hit in sorted(one, key=lambda h: (-round(h[1], 2), -h[2], -h[1], h[3], h[0])):
        if not any(2 * (min(hit[4], k[4]) - max(hit[3], k[3])) > hit[4] - hit[3] for k in kept):
            kept.append(hit)
    return sorted(kept, key=lambda h: (h[3], h[0]))


def statements(text: str, judge) -> Iterator[tuple[int, str, float, float]]:
    """(line number, family, probability, share) of every statement in a text."""
    if not _CAN.search(text.lower()):
        return
    for words, of in paragraphs(text):
        known = [0, *accumulate(p in _PAIRS for p in zip(words, words[1:])), 0]
        if known[-2] < _LEAST_PAIRS:
            continue
        hits = []
        for at, end in windows(of):
            if known[max(at, end - 1)] - known[at] >= _LEAST_PAIRS:
                hits += [(f, p, share, at + a, at + b) for f, p, share, a, b in judge(words[at:end])]
        for family, p, share, first, _ in merged(hits):
            yield of[first], family, p, share


def licences(docs: DataFrame, background: int = BACKGROUND) -> DataFrame:
    """One row per licence statement: doc_id, paragraph (number from 0 of its first line), family,
    probability, shared (of a template's pairs of words).

    The classifier is fitted on the templates and on the first lines, up to `LEARNED` characters,
    of at most about `background` rows of `docs`, drawn by a hash of doc_id; every line of every
    row is then read whole. Repeated rows are each read.
    Null and empty texts state nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = int(min(1.0, background / max(1, docs.count())) * 1_000_000)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select(
        F.element_at(F.split("text", "\n"), 1).alias("line"), "doc_id"
    )
    lines = drawn.where("line IS NOT NULL").orderBy("doc_id", "line").limit(2 * background).collect()
    model = spark.sparkContext.broadcast(train([r.line[:LEARNED] for r in lines]))  # 2**BITS numbers a family

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple]] = {}

        def judge(part: list[str]) -> list[tuple]:
            key = " ".join(part)
            if key not in known:
                if len(known) > 50_000:
                    known.clear()
                known[key] = model.value.judge(part)
            return known[key]

        for batch in sliced(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(doc, *found) for found in statements(text or "", judge)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "paragraph", "family", "probability", "shared"],
            )

    schema = "doc_id long, paragraph int, family string, probability double, shared double"
    return docs.mapInArrow(scan, schema)
