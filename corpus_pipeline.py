"""The corpus pipeline: documents to packed sequences, five stages that each call one operator.

Every stage is written as Parquet and read again, so a stage starts from files and a lost
executor costs a part of one stage. When a stage starts, the intermediate tables of the
one before are deleted: its result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.functions.storage import copies, drop_copies, scratch_path
from tablewright.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tablewright.llm.tables import release, ship, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_MADE: list[str] = []  # intermediate tables of the last stage


def stage(function: Stage) -> Stage:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        drop_copies(spark, _MADE)
        release(spark)
        before = set(copies())
        out = function(spark, docs, sf_dir)
        _MADE[:] = [p for p in copies() if p not in before]
        return out

    return run_stage


@stage
def clean_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, restored texts judged."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.last_of_each(docs)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar texts the document with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes."""
    return mixing.mixed_rows(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack(packing.piece_rows(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_texts),
    ("exact dedup", without_copies),
    ("n-gram jaccard join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learning, tokenizing and packing have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES:
        path = scratch_path(spark, "stage")
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
