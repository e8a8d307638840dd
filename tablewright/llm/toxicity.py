"""Toxicity of restored texts, learned from labelled documents.

Three steps learn, one scores:
1. character 4-grams of the words of all documents (at most 28**4 sums reach the driver);
2. over labelled documents, in how many toxic and how many other ones each word and word
   beginning of the restored text occurs (2**18 hashed counts);
3. over labelled documents kept from step 2, a logistic regression on the highest word
   scores of a document.
Labelled documents are a sample of at most about `max_labelled` rows, drawn by a hash of
doc_id; their ids are broadcast. Scores depend on the text alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deobfuscate import CELLS, SPACED, Restorer, count_grams, log_probabilities
from .tables import lean, sliced, written

MAX_LABELLED = 60_000
BITS = 18
PREFIXES = (4, 5, 6)
TOP = 4  # highest word scores that a document's score looks at
CACHE = 400_000  # tokens whose score a task remembers
_MASK = (1 << BITS) - 1
_PIECES = tuple(zip((0, *PREFIXES), PREFIXES))  # that beginnings are made of
FOLDS = 5
THRESHOLD = 0.5
STACK_FOLD = 4


def fold_of(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in sliced(batches, "text", 1 << 20):
        yield batch, [(t or "").lower() for t in batch.column("text").to_pylist()]


def gram_counts(docs: DataFrame) -> np.ndarray:
    """4-gram counts over the words of all rows."""

    @lean
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(CELLS), Counter()
        for _, texts in _texts(batches):
            for text in texts:
                words.update(text.split())
            if len(words) > CACHE:
                total += count_grams(_plain(words))
                words = Counter()
        total += count_grams(_plain(words))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(total[cell].astype(np.int64))], names=["cell", "n"]
        )

    rows = docs.select("text").mapInArrow(grams, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    counts = np.zeros(CELLS)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def _plain(words: Counter) -> Counter:
    """Only the words of letters, without the marks around them."""
    out: Counter = Counter()
    for word, n in words.items():
        core = word if word.isalpha() else word.strip(".,;:!?\"'()")
        if core.isalpha():
            out[core] += n
    return out


def tokens(text: str, restorer: Restorer) -> tuple[set[str], list[str]]:
    """Distinct tokens of a lower-case text, and the words that spaced letters read as."""
    spaced: list[str] = []
    if SPACED.search(text):
        for found in SPACED.finditer(text):
            spaced += restorer.spaced("".join(found[0].split()))
        text = SPACED.sub(" ", text)
    # Readings don't depend on a full stop or comma behind a token; without it fewer differ.
    for mark in (". ", ", ", ".\n", ",\n"):
        text = text.replace(mark, mark[1])
    return set(text.split()), spaced


def features(word: str) -> list[int]:
    """Hashed names of a word and of its beginnings."""
    names = [f"{word}$", *(word[:n] for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(n.encode()) & _MASK for n in names]


def _learned(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Labelled rows (text, toxic, fold) for learning."""
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.withColumn("fold", fold_of(F.col("doc_id"))).where("fold <> 0")
    share = int(min(1.0, max_labelled / max(1, labels.count())) * 1_000_000)
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about max_labelled rows at most
    return rows.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold"))


def word_weights(rows: DataFrame, model) -> np.ndarray:
    """Log odds of each hashed feature: how much likelier it is in toxic documents."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        known: dict[str, list[int]] = {}
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch, texts in _texts(batches):
            for text, toxic in zip(texts, batch.column("toxic").to_pylist()):
                plain, spaced = tokens(text, restorer)
                found: set[int] = set()
                for token in plain:
                    have = known.get(token)
                    if have is None:
                        have = known[token] = [f for w in restorer.words(token) for f in features(w)]
                    found.update(have)
                for word in spaced:
                    found.update(features(word))
                side = counts[1 if toxic else 0]
                side[list(found)] += 1
                side[-1] += 1
                if len(known) > CACHE:
                    known.clear()
        cell = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(counts[0, cell]), pa.array(counts[1, cell])],
            names=["cell", "other", "toxic"],
        )

    rows = rows.where(F.col("fold") != STACK_FOLD).select("text", "toxic")
    sums = rows.mapInArrow(counted, "cell int, other long, toxic long").groupBy("cell")
    found = sums.agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()
    counts = np.zeros((2, (1 << BITS) + 1))
    counts[0, found["cell"].to_numpy()] = found["other"].to_numpy()
    counts[1, found["cell"].to_numpy()] = found["toxic"].to_numpy()
    all_rows = counts[:, -1:] + 1
    odds = np.log((counts[1, :-1] + 0.5) / all_rows[1]) - np.log((counts[0, :-1] + 0.5) / all_rows[0])
    return np.where(counts[:, :-1].sum(0) >= 3, odds, 0.0).astype(np.float32)


class Scorer:
    """The highest word scores of texts; remembers the scores of tokens."""

    def __init__(self, model: np.ndarray, weights: np.ndarray):
        self.restorer, self.weights, self.known = Restorer(model), weights.tolist(), {}

    def of_words(self, words: list[str]) -> float:
        return max(map(self.of_word, words), default=0.0)

    def of_word(self, word: str) -> float:
        """The largest weight of the word's `features`, whose hashes continue each other."""
        weights = self.weights
        if not word.isascii():
            return max(weights[f] for f in features(word))
        data = word.encode()
        top, last = weights[zlib.crc32(data + b"$") & _MASK], 0
        for start, end in _PIECES:
            if len(data) <= end:
                break
            last = zlib.crc32(data[start:end], last)
            if weights[last & _MASK] > top:
                top = weights[last & _MASK]
        return top

    def look(self, text: str) -> list[float]:
        plain, spaced = tokens(text, self.restorer)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        scores = [known.get(t) for t in plain]
        if None in scores:
            for t in plain:
                if t not in known:
                    known[t] = self.of_words(self.restorer.words(t))
            scores = [known[t] for t in plain]
        scores += [self.of_words([w]) for w in spaced]
        top = sorted(scores, reverse=True)[:TOP]
        return top + [0.0] * (TOP - len(top))


_SCORER: dict[tuple[int, int], Scorer] = {}


def scorer_of(model: np.ndarray, weights: np.ndarray) -> Scorer:
    """The scorer of this model, kept between the tasks of a worker: one at a time, and what it
    remembers is bounded."""
    key = zlib.crc32(np.ascontiguousarray(model)), zlib.crc32(np.ascontiguousarray(weights))
    if key not in _SCORER:
        _SCORER.clear()
        _SCORER[key] = Scorer(model, weights)
    return _SCORER[key]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the last coefficient is the constant's."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w)) * np.array([*[1.0] * (len(w) - 1), 0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + keep @ w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), slope)
    return w


class Model:
    """What is learned from `docs` and `labels`; `scorer()` gives a function of lower-case texts."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_labelled: int):
        sc = docs.sparkSession.sparkContext
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        grams = sc.broadcast(log_probabilities(gram_counts(docs)))  # 28**4 numbers
        rows = written(_learned(docs, labels, max_labelled))
        weights = sc.broadcast(word_weights(rows, grams))  # 2**BITS numbers

        @lean
        def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = scorer_of(grams.value, weights.value)
            for batch, texts in _texts(batches):
                found = pa.array([scorer.look(t) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), found], names=["toxic", "x"])

        held = rows.where(F.col("fold") == STACK_FOLD).select("text", "toxic")
        known = held.mapInArrow(looked, "toxic int, x array<double>").collect()  # a fifth of max_labelled rows
        x = np.array([r.x for r in known]).reshape(-1, TOP)
        y = np.array([float(bool(r.toxic)) for r in known])
        self.coefficients = fit(x, y) if 0 < y.sum() < len(y) else _constant(y)
        self.grams, self.weights = grams, weights

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        scorer = scorer_of(self.grams.value, self.weights.value)

        def scores(texts: list[str]) -> np.ndarray:
            x = np.array([scorer.look(t) for t in texts]).reshape(-1, TOP)
            z = x @ self.coefficients[:-1] + self.coefficients[-1]
            return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

        return scores


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    `labels` (doc_id, toxic) may miss documents; rows whose doc_id hashes to fold 0 are
    never learned from. Null texts count as empty. Without labels of both kinds all
    scores are the share of toxic labels (0 without any). Other columns are ignored.
    """
    model = Model(docs, labels, max_labelled)

    @lean
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not predicted to be toxic."""
    model = Model(docs, labels, max_labelled)

    @lean
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch, texts in _texts(batches):
            yield batch.filter(pa.array(scores(texts) < THRESHOLD))
        _SCORER.clear()  # other work follows in these processes

    return docs.mapInArrow(kept, docs.schema)


def _constant(y: np.ndarray) -> np.ndarray:
    share = float(y.mean()) if len(y) else 0.0
    return np.array([0.0] * TOP + [np.log((share + 1e-9) / (1 - share + 1e-9))])
