"""Mixing overlapping sources to target weights by a min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern;
only these sums (one row per pattern, at most `max_patterns`, else an error) reach the
driver. There words flow from patterns to the sources' targets: each pattern offers its
words once for every allowed copy, and later copies cost more, so nothing is repeated
while a first copy could serve. Documents are then selected in a seeded order until their
pattern's flow is reached. They are taken whole or not at all: the document at the border
goes with whichever end is nearer to the flow, so each copy of a pattern is off by half a
document at most.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import WORD, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix to words of all sources
MOST = 2  # copies of a document at most
MAX_PATTERNS = 100_000
MAX_BUCKETS = 1 << 16
ROWS_A_BUCKET = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighted_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`sources` (source, source_size) with `target`, in words.

    Sources in code point order, null last, take the weights in turn and share `share`
    times all words. No target is over `most` times its source: what is over is shared
    again by weight. With sources ordered by limit / weight, those before some row are at
    their limit and all others at weight times one level, which has a closed form.
    All windows here run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    rows = rows.withColumn("limit", most * F.col("source_size")).withColumn("at", F.col("limit") / F.col("weight"))
    by_limit = Window.orderBy("at", F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(all_rows) - before) / after)
    rows = rows.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")))
    rows = rows.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("at"))).over(all_rows))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", target.alias("target"))


def route(patterns: list[tuple[list[str], int]], quotas: dict[str, int], copies: int) -> list[list[int]]:
    """Words of each pattern used as first copy, second copy, ...: the flow that fills most
    of the quotas and, of those, has the least cost, when every further copy costs more.

    Costs depend on the copy only, so the cheapest way to add flow is always along a path
    that starts with the lowest copy that still has one: copies are opened in turn, and
    for each the flow is augmented as far as it goes.
    """
    flow: list[dict[str, int]] = [{} for _ in patterns]
    users: dict[str, set[int]] = {}
    room = dict(quotas)
    used: list[list[int]] = [[] for _ in patterns]

    def push(p: int, source: str, words: int) -> None:
        flow[p][source] = flow[p].get(source, 0) + words
        users.setdefault(source, set())
        (users[source].add if flow[p][source] else users[source].discard)(p)

    def augment(start: int, most: int) -> int:
        """Send at most `most` words from `start` to a source with room, moving others aside."""
        came: dict[str, tuple[int, str | None]] = {}
        queue = deque((start, s, None) for s in patterns[start][0])
        while queue:
            p, source, via = queue.popleft()
            if source in came or source not in room:
                continue
            came[source] = p, via
            if room[source]:
                path, at = [], source
                while at is not None:
                    path.append((came[at][0], at, came[at][1]))
                    at = came[at][1]
                words = min([most, room[source], *(flow[p][old] for p, _, old in path if old is not None)])
                room[source] -= words
                for p, new, old in path:
                    push(p, new, words)
                    if old is not None:
                        push(p, old, -words)
                return words
            queue.extend((q, s, source) for q in sorted(users.get(source, ())) for s in patterns[q][0])
        return 0

    for _ in range(copies):
        for p, (_, capacity) in enumerate(patterns):
            sent = 0
            while sent < capacity and (words := augment(p, capacity - sent)):
                sent += words
            used[p].append(sent)
    return used


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, most: int = MOST, max_patterns: int = MAX_PATTERNS):
    """`docs` (doc_id, size, members: array of source names, and others) with `taken`: words the
    mix takes of each row, repeats counted, at most `most` times its size.

    `targets` has (member, target) in words. Rows of unknown sources, of no source and of
    size 0 give nothing. Rows that repeat a doc_id are documents of their own. The order
    in which documents are taken depends on seed and doc_id only; where that is null, on `tie`
    (a long column that `docs` may have). `copies` has the words of each copy, 0 or `size`.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("members", F.array_sort(F.array_distinct(F.coalesce("members", F.array().cast("array<string>")))))
    sums = docs.groupBy("members").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    rows = sums.orderBy("members").limit(max_patterns + 1).collect()
    quotas = {r.member: int(r.target) for r in targets.limit(max_patterns + 1).collect()}
    if max(len(rows), len(quotas)) > max_patterns:
        raise ValueError(f"more than {max_patterns} sources or membership patterns")
    flows = route([(r.members, r.words) for r in rows], quotas, most)
    table = [
        (i, r.members, min(MAX_BUCKETS, -(-r.rows // ROWS_A_BUCKET)), f) for i, (r, f) in enumerate(zip(rows, flows))
    ]
    schema = "pattern int, members array<string>, buckets int, flows array<bigint>"
    patterns = F.broadcast(spark.createDataFrame(table, schema))  # at most max_patterns rows

    unnamed = F.concat(F.lit("null"), F.col("tie").cast("string")) if "tie" in docs.columns else F.lit("null")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), unnamed)))
    docs = docs.join(patterns, "members").withColumn("key", key)
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    docs = docs.withColumn("bucket", F.floor(share * F.col("buckets")).cast("int"))
    sizes = docs.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("pattern", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    docs = docs.join(sizes, ["pattern", "bucket"])
    before = F.col("first") + F.col("inside")
    parts = [
        F.when(2 * (F.col("flows")[k] - before) >= F.col("size"), F.col("size")).otherwise(0).cast("long")
        for k in range(most)
    ]
    docs = docs.withColumn("copies", F.array(*parts))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn("taken", taken).drop(
        "pattern", "bucket", "buckets", "flows", "key", "first", "inside", "members", "tie"
    )


def member(source: Column) -> Column:
    """A name for every source, null included."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mix_by_source(docs: DataFrame, seed: int = 0, with_rows: bool = False) -> DataFrame:
    """Mix `docs` by its `source` column with the targets of `weighted_targets`: doc_id, size,
    source_size, target, taken, copies (words of each copy), and `row` (all columns of
    `docs`) if asked for. Null texts have size 0; null is a source of its own."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        member(F.col("source").cast("string")).alias("member"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie"),
        *([F.struct(*docs.columns).alias("row")] if with_rows else []),
    )
    rows = written(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(weighted_targets(sizes)).withColumn("member", member(F.col("source"))).drop("source")
    quotas = targets.select("member", F.floor("target").cast("long").alias("target"))
    mixed = mix(rows.drop("source").withColumn("members", F.array("member")), quotas, seed)
    return mixed.join(targets, "member").drop("member")


def mixed_rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: a row of `docs` (doc_id, text, source and others) for every copy taken."""
    mixed = mix_by_source(docs, seed, with_rows=True)
    return mixed.select("row", F.explode("copies").alias("words")).where("words > 0").select("row.*")
