"""The registered queries of this package: thin calls of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tablewright.functions.storage import scratch_path

from . import (
    centroids,
    exact_dedup,
    fingerprints,
    licences,
    minhash,
    mixing,
    negatives,
    ngram_join,
    packing,
    paragraphs,
    repair,
    toxicity,
    url_filter,
)
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


@_query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "copies")


@_query
def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept", "copies")


def _jaccard_sql(size: int, last: str = "") -> str:
    """All pairs with a common shingle, counted, and what their links reach."""
    return rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= {size}
    THEN list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingles
  FROM worded),
apart AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM apart x JOIN apart y USING (shingle)
  WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 80 * (len(x.shingles) + len(y.shingles) - n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, w.b FROM reached r JOIN ways w ON r.b = w.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id{last},
  count(*) OVER (PARTITION BY list_sort(shingles)) AS copies
FROM sets JOIN least ON least.a = doc_id
"""


ORACLE["op8_ngram_join"] = _jaccard_sql(5)
ORACLE["op13_minhash_dedup"] = _jaccard_sql(4, ", doc_id = component_id AS kept")


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op6_exact_dedup"] = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY text)
"""


@_query
def op2_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    repair.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return repair.read_ids(spark, path)


@_query
def op10_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.piece_rows(docs, public_tokenizers.path("word_bpe_49k.json")))


@_query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_by_source(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op1_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
limits AS (SELECT *, 2 * source_size / weight AS limit_at FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
      - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY limit_at, source IS NULL, source
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(weight) OVER (ORDER BY limit_at, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)
    AS level FROM limits),
water AS (SELECT arg_min(level, limit_at) AS level FROM levels WHERE level * weight <= 2 * source_size),
targets AS (
  SELECT source, source_size,
    least(CAST(2 * source_size AS DOUBLE), coalesce((SELECT level FROM water) * weight, 2 * source_size)) AS target
  FROM levels),
ordered AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(concat('0:', doc_id)), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN 2 * (least(quota, source_size) - before) >= size THEN size ELSE 0 END
  + CASE WHEN 2 * (quota - least(quota, source_size) - before) >= size THEN size ELSE 0 END AS taken
FROM ordered
"""


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@_query
def op9_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.lz_fingerprints(table(spark, sf_dir, "documents"))


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


@_query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


#: Vectors of whole numbers, without those that take no part.
_WHOLE = """
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLE["op11_hard_negatives"] = f"""
WITH whole AS ({_WHOLE.format(scale=256)} AND label IS NOT NULL),
rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, v FROM whole),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negatives AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3
"""


@_query
def op12_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


def _clusters_sql(rounds: int = 3) -> str:
    """Every round as a step of its own: distances to all centroids, then floors of the means."""
    squared = "CAST(list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = [
        f"whole AS MATERIALIZED (SELECT *, row_number() OVER () AS place FROM ({_WHOLE.format(scale=64)} AND len(embedding) = 64))",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v FROM whole "
        "QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16)",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, v, min(code) % 16 AS k, min(code) // 16 AS d FROM "
            f"(SELECT r.vec_id, r.v, r.place, 16 * {squared} + c.k AS code FROM whole r CROSS JOIN c{i} c) GROUP BY place, vec_id, v)"
        )
        if i < rounds:
            steps.append(
                f"m{i} AS (SELECT k, list(f ORDER BY i) AS v FROM (SELECT k, i, CAST(floor_mean AS BIGINT) AS f FROM "
                f"(SELECT k, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean FROM "
                f"(SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY k, i)) GROUP BY k), "
                f"c{i + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k))"
            )
    return (
        f"WITH {', '.join(steps)} SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, "
        "CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (k)"
    )


ORACLE["op12_ptolemaic_clusters"] = _clusters_sql()


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
