"""Substring matching says what a search for each word says."""

import random

from tablewright.operators.questions import _matcher

RULES = [["up", "upper", "upper hand"], ["trend", "trending"], ["max", "maximum"], ["by "], ["what", "what about"], ["a.b"], ["\u00e9t", "\u00e9t\u00e9"]]


def test_words_around_others_add_nothing(spark):
    rng = random.Random(5)
    pieces = [w for words in RULES for w in words] + [" ", "x", "trendin", "ma", "u", "p"]
    texts = ["", " ", *["".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(800)]]
    mentions = _matcher("substring")
    out = spark.createDataFrame([(t,) for t in texts], "_tw_text string").selectExpr(
        "_tw_text", *[f"{mentions(words)} AS r{k}" for k, words in enumerate(RULES)]
    )
    for row in out.collect():
        for k, words in enumerate(RULES):
            assert row[f"r{k}"] == any(w in row["_tw_text"] for w in words), (row["_tw_text"], words)
