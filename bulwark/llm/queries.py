"""The training-data operators as queries: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from bulwark.llm import (
    bpe,
    fill_in_middle,
    hnsw,
    langid,
    lblm,
    mixing,
    quality,
    rtree,
    secret_scan,
    simhash,
    token_files,
    toxicity,
    weighted_sampling,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def op5_bpe_round_trip(spark, sf):
    return bpe.digests(bpe.encode(_documents(spark, sf), bpe.public_vocabulary(), decoded=True))


@query
def op4_simhash_groups(spark, sf):
    return simhash.groups(_documents(spark, sf))


@query
def op2_mixture_quotas(spark, sf):
    return mixing.taken(_documents(spark, sf))


@query
def op10_secret_spans(spark, sf):
    return secret_scan.report(_documents(spark, sf))


@query
def op6_weighted_fingerprints(spark, sf):
    return weighted_sampling.digests(weighted_sampling.edited(_documents(spark, sf)))


@query
def op8_log_bilinear_scores(spark, sf):
    return lblm.scores(_documents(spark, sf))


@query
def op7_languages(spark, sf):
    return langid.identified(_documents(spark, sf))


@query
def op9_toxicity_scores(spark, sf):
    return toxicity.scored(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op1_quality_grades(spark, sf):
    return quality.graded(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op3_hnsw_groups(spark, sf):
    return hnsw.groups(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query
def op11_fill_in_middle(spark, sf):
    return fill_in_middle.digests(fill_in_middle.arranged(_documents(spark, sf)))


ORACLES["op11_fill_in_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
), plan AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS prefix,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM plan
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query
def op12_hard_negatives(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(rtree.scaled(vectors.withColumn("label", label)), F.col("id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH r AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, r.id, r.label, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a JOIN r ON len(a.v) = len(r.v) AND a.id <> r.id
  WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score
  FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives AS p
JOIN scores AS s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


@query
def op13_token_files(spark, sf):
    return token_files.round_trip(_documents(spark, sf), token_files.public_vocabulary())


@query
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
