"""The thin queries over the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, jaccard_join, language, media, mixing, quality, substring_dedup, suffix_dedup, token_files, topk
from .common import read_documents


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(read_documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(read_documents(spark, sf_dir))


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read_documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 50 == 0, 5)


def op8_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.digests(token_files.write(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return quality.scores(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return language.predict(docs, language.learn(docs))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_webp": op1_webp,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_topk": op5_topk,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_rans": op8_rans,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
}
ORACLES: dict[str, str] = {"op5_topk": OP5_SQL, "op7_pareto_mix": mixing.ORACLE}
