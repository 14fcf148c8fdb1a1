"""Files of source trees, and other tables of the engine, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_tree(spark: SparkSession, root: str, repo_id: str | None = None, glob: str | None = None) -> DataFrame:
    """repo_id, file_seq, path, content, size of all files below root.

    Text is UTF-8 with line ends as \\n; bytes that are none become replacement characters."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    base = root.rstrip("/") + "/"
    path = F.substring_index("path", base, -1)
    content = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return reader.load(root).select(F.lit(repo_id or root).alias("repo_id"), F.xxhash64(path).alias("file_seq"), path.alias("path"), content.alias("content"), F.col("length").alias("size"))


def from_table(rows: DataFrame, repo: Column, seq: Column, path: Column, content: Column) -> DataFrame:
    """Files from any table that holds texts."""
    return rows.select(repo.cast("string").alias("repo_id"), seq.cast("long").alias("file_seq"), path.alias("path"), content.alias("content")).withColumn("size", F.octet_length("content").cast("long"))


def from_pages(pages: DataFrame) -> DataFrame:
    return from_table(pages, F.regexp_extract("url", "^https?://([^/]+)", 1), F.col("page_id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))


def from_conversations(turns: DataFrame) -> DataFrame:
    path = F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt"))
    return from_table(turns, F.lit("conversations"), F.col("conv_id") * 10000 + F.col("turn"), path, F.col("text"))
