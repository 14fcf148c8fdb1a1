"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """u, v and the least of u's neighbours v and u itself. A hub's rows stay where a skewed join puts them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("__u")).select("u", "v", "m")


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root: the least node of its component, for every node of an edge (u, v) with u <> v.

    Each round hangs neighbours on smaller nodes and is written to the shared folder; it ends when nothing moves,
    after about the logarithm of the longest path's length."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), label)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, label)
        small = _least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), label)
        # A star forest has as many edges as nodes below roots; it is reached when a round changes nothing.
        if _fingerprint(after) == _fingerprint(now):
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = after


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
