"""A corpus pipeline of five stages over `documents`; each stage's result is written and read again as the next one's input.

Language identification drops documents without a language; the Jaccard join keeps the first document of each
class of near copies; substring dedup cuts repeated windows of twenty words, and a document that loses none
keeps its text as it is; mixing takes each source near its target, so that documents may repeat; byte-level
BPE ends with token ids and what they decode to.

The stages pass on the columns of the documents; n_chars follows the text. Rows whose text loses everything in
substring dedup stay, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import byte_bpe, jaccard_join, language, mixing, substring_dedup
from sievework.llm.common import folded, materialize, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has a language."""
    return language.accepted(docs, language.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class."""
    return jaccard_join.first_of_each_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated windows of twenty words."""
    rows, back = folded(docs)
    found = substring_dedup.remove_repeats(rows, keep=("doc_id", "others"), whole=True)
    out = found.select(*back("kept"), F.col("n_removed").alias("__removed"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source near its target."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, and digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("doc_id", "source"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]
#: Models, suffix cuts and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage wrote on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
