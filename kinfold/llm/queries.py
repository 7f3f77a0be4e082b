"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, jaccard_join, language_id, line_dedup, mixing, packing, quality, secret_scan, topk_search, toxicity
from .common import crc_mod, table


def _held_out(modulus: int, held: int) -> Column:
    """False for a row without doc_id, which is learned from by nobody."""
    return F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_mod("doc_id", 4) != 2))
    out = language_id.predict(docs, model)
    return out.select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0]


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped", "n_cut")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def _labels(spark: SparkSession, sf_dir: str, label: str, modulus: int, held: int) -> DataFrame:
    """The labels that may be learned from."""
    return table(spark, sf_dir, "labels").where(crc_mod("doc_id", modulus) != held).select("doc_id", F.col(label).alias("label"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, _labels(spark, sf_dir, "quality", 3, 1))
    out = quality.predict(docs, net)
    return out.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.fit(docs, _labels(spark, sf_dir, "toxic", 4, 2))
    out = toxicity.predict(docs, index)
    return out.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "neighbours", "terms")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_packing": op2_packing,
        "op3_mixing": op3_mixing,
        "op4_topk_search": op4_topk_search,
        "op5_line_dedup": op5_line_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_secret_scan": op7_secret_scan,
        "op8_quality": op8_quality,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_toxicity": op10_toxicity,
        "pipeline": pipeline,
    }


_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

_NEAR = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach(id, node) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.node
), part AS (SELECT id, min(node) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, part.component_id, v.vec_id = part.component_id AS kept
FROM v JOIN part ON part.id = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_topk_search": _TOPK, "op9_embedding_dedup": _NEAR}
