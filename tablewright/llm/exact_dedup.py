"""Exact deduplication as a stateful stream, in DataFrame operations only.

The rows are written once, as the content store, each with the digest of its normalised text. A Structured Streaming query
over its files groups rows by digest. Its state is on disk (RocksDB), keyed by digest, and
never expires: per digest the largest doc_id, the locator of that row's content (file and
number of the row in the store) and the number of rows. The state is read back with the
`statestore` source, so nothing passes through the driver.

A digest is a proposal. The whole text of every hit is compared with the text its locator
names; rows that differ though their digests agree are grouped by the text itself. Hot
groups are dealt out by a salt, with one copy of the kept text for each salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.storage import scratch_path

from .tables import lower_ascii

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # No space set aside ahead: with many small state partitions that takes most of the disk.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ROWS_A_SALT = 2000
_LOCATOR = "concat(_metadata.file_name, '#', lpad(CAST(_metadata.row_index AS STRING), 12, '0'))"


def _state(spark: SparkSession, store: str, digest: Callable[[Column], Column], bytes_a_batch: int) -> DataFrame:
    """(digest, keep_id, locator, group_size) of the store, by a stream over its files."""
    stream = spark.readStream.schema(spark.read.parquet(store).schema)
    rows = stream.option("maxBytesPerTrigger", bytes_a_batch).parquet(store)
    rows = rows.select("doc_id", digest(F.col("sha")).alias("digest"), F.expr(_LOCATOR).alias("locator"))
    grouped = rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("group_size")
    )
    checkpoint = scratch_path(spark, "stream")
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        writer = grouped.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
        writer.option("checkpointLocation", checkpoint).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    state = spark.read.format("statestore").load(checkpoint)
    keep, number = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.{keep}.doc_id").alias("keep_id"),
        F.col(f"value.{keep}.locator").alias("keep_locator"),
        F.col(f"value.{number}").alias("group_size"),
    )


def _text(text: Column) -> Column:
    return lower_ascii(F.coalesce(text.cast("string"), F.lit("")))


def _resolved(docs: DataFrame, digest: Callable[[Column], Column], bytes_a_batch: int) -> tuple[DataFrame, DataFrame]:
    """The content store of `docs` (row, doc_id, sha, locator), and per row of it doc_id, sha,
    locator, keep_id, keep_locator, group_size."""
    spark = docs.sparkSession
    store = scratch_path(spark, "content")
    sha = F.unhex(F.sha2(_text(F.col("text")).cast("binary"), 256))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha"))
    rows.write.parquet(store)
    state = _state(spark, store, digest, bytes_a_batch)
    content = spark.read.parquet(store).selectExpr("*", f"{_LOCATOR} AS locator")
    content = content.withColumn("digest", digest(F.col("sha")))
    narrow = content.select("doc_id", "sha", "digest", "locator").join(state, "digest")
    apart = _differing(content, state)
    return content, narrow if apart.isEmpty() else _regrouped(narrow, apart)


def exact_duplicates(
    docs: DataFrame, digest: Callable[[Column], Column] = lambda sha: sha, bytes_a_batch: int = 256 << 30
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row
    with the largest doc_id stays; of several such rows (or where no row of a group has a
    doc_id) the one with the last locator. `digest` may be any function of the text's
    SHA-256: the byte check settles what it leaves open. Other columns are ignored.
    """
    _, rows = _resolved(docs.select("doc_id", "text"), digest, bytes_a_batch)
    kept = F.col("locator") == F.col("keep_locator")
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def last_of_each(docs: DataFrame, bytes_a_batch: int = 256 << 30) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    content, rows = _resolved(docs, lambda sha: sha, bytes_a_batch)
    kept = rows.where("locator = keep_locator").select("locator")
    return content.join(kept, "locator", "left_semi").select("row.*")


def _differing(content: DataFrame, state: DataFrame) -> DataFrame:
    """(locator, digest, doc_id, text) of rows whose text is not the text their digest's locator names."""
    spark = content.sparkSession
    salts = F.ceil(F.col("group_size") / ROWS_A_SALT).cast("int")
    groups = state.where("group_size > 1").select("digest", "keep_locator", salts.alias("salts"))
    path = scratch_path(spark, "hits")
    content.select("doc_id", "digest", "locator", _text(F.col("row.text")).alias("text")).join(groups, "digest").write.parquet(path)
    hits = spark.read.parquet(path)
    kept = hits.where("locator = keep_locator").select(
        "digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    others = hits.where("locator <> keep_locator")
    others = others.withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int"))
    path = scratch_path(spark, "differing")
    apart = others.join(kept, ["digest", "salt"]).where("text <> kept_text")
    apart.select("locator", "digest", "doc_id", "text").write.parquet(path)
    return spark.read.parquet(path)


def _regrouped(narrow: DataFrame, apart: DataFrame) -> DataFrame:
    """`narrow` with the differing rows in groups of their own, by their texts."""
    own = apart.groupBy("digest", "text").agg(
        F.max(F.struct("doc_id", "locator")).alias("own"), F.count("*").alias("own_size")
    )
    own = apart.join(own, ["digest", "text"]).select("locator", "own", "own_size")
    fewer = apart.groupBy("digest").agg(F.count("*").alias("fewer"))
    both = narrow.join(own, "locator", "left").join(fewer, "digest", "left")
    left = F.col("group_size") - F.coalesce("fewer", F.lit(0))
    moved = F.col("own_size").isNotNull()
    return both.select(
        "doc_id",
        "sha",
        "locator",
        F.when(moved, F.col("own.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(moved, F.col("own.locator")).otherwise(F.col("keep_locator")).alias("keep_locator"),
        F.coalesce("own_size", left).alias("group_size"),
    )
