"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Targets. Sources in code-point order, null last, get the weights in turn. Together they take `share` of all
words; no target exceeds `cap` times its source. What a capped source cannot take goes to the others by
weight, which is the level L at which the minima of (cap, weight * L) add up: the sources are sorted by
cap / weight, and running sums tell which of them stop at their cap.

Sampling. A source with target t and size S gives every document floor(t / S) whole copies. The rest, a share
p of the source, is a sample without replacement: documents are ranked by the random odds u / (1 - u) divided
by the inclusion odds p / (1 - p), u being a hash of doc_id, and taken from the smallest on until their words
are as near to the rest as whole documents allow. All documents of a source have one p, so the ranks have the
order of u: a histogram of words over u finds the bin of the last document taken, and only that bin's
documents are ordered. No source is ever gathered in one task.

Defined results: null or empty text has size 0 and takes nothing; a source without words has target 0; rows
that repeat a doc_id share their rank and are taken together; an empty table gives an empty table; reruns
agree, as u depends on doc_id and `seed` alone; other columns pass through `mix` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, materialize

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Bins of the random numbers; a bin holds that part of a source.
BINS = 4096
SEED = "mix"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RE)).cast("long")


def random(doc_id: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1, neither of them, from a document's id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds; null where nothing is included."""
    return F.try_divide(u / (1 - u), F.try_divide(p, 1 - p))


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target; by_source has source and source_size."""
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("double")
    x = by_source.withColumn("w", weight).withColumn("most", cap * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("all", share * F.sum("source_size").over(everything).cast("double")).withColumn("all_w", F.sum("w").over(everything))
    x = x.withColumn("most_before", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    x = x.withColumn("stops", F.col("most") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("all") - F.col("most_before")))
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(everything), F.lit(0.0))
    rest_w = F.sum(F.when(~F.col("stops"), F.col("w"))).over(everything)
    return x.withColumn("target", F.when(F.col("stops"), F.col("most")).otherwise(rest * F.col("w") / rest_w)).select("source", "source_size", "target")


def decisions(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """For each source: source_size, target, whole copies, inclusion p, and rank and id of the last document taken.

    sized has doc_id, source, size, u."""
    bins = sized.groupBy("source", F.floor(F.col("u") * BINS).alias("bin")).agg(F.sum("size").alias("bin_size"))
    # The bins are a few thousand for each source, whatever the number of documents.
    bins = materialize(bins, "mix-bins")
    plan = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    plan = plan.withColumn("p", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(F.lit(0.0)))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = bins.withColumn("upto", F.sum("bin_size").over(run)).withColumnRenamed("source", "of")
    edge = plan.join(edge, F.col("source").eqNullSafe(F.col("of"))).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("bin_size") < F.col("rest")))
    edge = edge.select(F.col("of"), F.col("bin").alias("edge_bin"), (F.col("upto") - F.col("bin_size")).alias("before"), "rest", "p")
    last = sized.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.floor(F.col("u") * BINS) == F.col("edge_bin")))
    last = last.groupBy("of", "doc_id", "before", "rest", pareto_rank(F.col("u"), F.col("p")).alias("rank")).agg(F.sum("size").alias("n"))
    run = Window.partitionBy("of").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("middle", F.col("before") + F.sum("n").over(run) - F.col("n") / 2).filter(F.col("middle") <= F.col("rest"))
    last = last.groupBy("of").agg(F.max(F.struct("rank", "doc_id")).alias("last"))
    # Where no document of the edge bin is taken, all of the bins before it are.
    out = plan.join(edge.select(F.col("of").alias("edge_of"), "edge_bin"), F.col("source").eqNullSafe(F.col("edge_of")), "left").drop("edge_of")
    return out.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "whole", "p", "edge_bin", "last")


def copies(u: Column, doc_id: Column, plan: Column) -> Column:
    """How many times a document is taken, by its source's decisions."""
    bin_, edge = F.floor(u * BINS), plan["edge_bin"]
    rank = F.struct(pareto_rank(u, plan["p"]).alias("rank"), doc_id.alias("doc_id"))
    sampled = (bin_ < edge) | ((bin_ == edge) & (rank <= plan["last"]))
    return plan["whole"] + F.coalesce(sampled, F.lit(False)).cast("int")


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), random(F.col("doc_id"), seed).alias("u"))


def _planned(docs: DataFrame, weights, share: float, cap: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes, and a row of decisions for each source."""
    sized = materialize(sizes(docs, seed), "mix-sizes")
    plan = materialize(decisions(sized, weights, share, cap), "mix-plan")
    return sized, plan.select(F.col("source").alias("__of"), F.struct("source_size", "target", "whole", "p", "edge_bin", "last").alias("__plan"))


def taken(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The contract's columns, and copies."""
    sized, plan = _planned(docs, weights, share, cap, seed)
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("__of"))).withColumn("copies", copies(F.col("u"), F.col("doc_id"), F.col("__plan")))
    return out.select("doc_id", "size", "__plan.source_size", "__plan.target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as many times as it is taken."""
    _, plan = _planned(docs, weights, share, cap, seed)
    out = docs.join(plan, F.col("source").eqNullSafe(F.col("__of")))
    n = copies(random(F.col("doc_id"), seed), F.col("doc_id"), F.col("__plan"))
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), n))).select(*docs.columns)


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({1 << 52} AS DOUBLE) AS u
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (
  SELECT source, source_size, CAST([{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS DOUBLE) AS w,
    CAST({CAP} AS DOUBLE) * source_size AS most, CAST({SHARE} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS everything FROM src),
o AS (
  SELECT *, sum(w) OVER () AS all_w,
    coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most_before,
    coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before FROM w),
s AS (SELECT *, most * (all_w - w_before) <= w * (everything - most_before) AS stops FROM o),
t AS (
  SELECT source, source_size, CASE WHEN stops THEN most ELSE
    (everything - coalesce(sum(CASE WHEN stops THEN most END) OVER (), 0)) * w / sum(CASE WHEN NOT stops THEN w END) OVER () END AS target FROM s),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole FROM t),
r AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM p),
q AS (SELECT *, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0 END AS p FROM r),
d AS (
  SELECT x.doc_id, x.size, q.source_size, q.target, q.whole, q.rest,
    sum(x.size) OVER (PARTITION BY x.source ORDER BY (x.u / (1 - x.u)) / (q.p / (1 - q.p)), x.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized x JOIN q ON x.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM d
"""
