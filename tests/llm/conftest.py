"""Small odd tables and plain-Python versions that the operators are held against."""

import random
import re
from collections import defaultdict

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = {"sig": 1, "id": "x", "n": 2.0, "words": 3, "row": 4, "locator": "l", "score": 5, "size": 6, "taken": 7, "digest": "d"}


def prose(rng, words, size=600):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(words))


def odd_rows():
    """Copies, near copies, nulls, blanks, ties, repeated rows, a very long text."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 4, 5, 6, 12, 40, 41, 200)]
    texts = [None, "", "  \n\t", "a", "A", "É é", *base, *[t.upper() for t in base[:4]], base[5], base[5]]
    for _ in range(25):
        words = base[rng.choice([4, 5, 6, 7])].split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        texts.append(" ".join(words))
    texts.append(prose(rng, 30_000, 5000))
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, base[4], None, "s1", None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASHES.items()])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_components(rows, size=5):
    """doc_id -> smallest doc_id reachable, all pairs compared; repeated ids are one document."""
    sets = [(d, shingle_set(t, size)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d in parent}


def groups_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return by
