"""Self-join of documents on the Jaccard similarity of their five-word shingles.

1. Documents with one shingle set form a copy class; one of them stands for the class from here on.
2. MinHash values in 32 bands of 4 make candidates: a pair at the threshold shares no band with probability
   (1 - 0.8^4)^32 < 5e-8. Bands only decide which documents must meet: those connected through bands form a
   neighbourhood, which is one unit of work, or, if large, is split in blocks of which every two form a unit.
   A unit holds a bounded number of documents, and no pair ever becomes a row.
3. In a unit, pairs that share a band are compared on their MinHash values, 32 at a time. With a uniform prior
   the posterior probability that similarity reaches the threshold, after m agreements of n, is the binomial
   probability of at most m successes in n + 1 trials; a pair leaves when it falls below TOLERANCE.
4. All others are verified exactly on their shingle sets.

Links are counted with the copies of both sides, and connected into classes. Defined results: words are runs
of characters that are not white space; a text of one to four words is one shingle; null and empty texts have
none, link to nothing and are classes of their own; repeated rows are copies; null doc_id comes first; an empty
table gives an empty table. Words are told apart by their bytes (longer ones by BLAKE2); the shingles of two
documents are compared by 64 bits from them under a key that is drawn for each run, and sets of one class by 128.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, bounded_batches, fresh_key, join_hashes, materialize, mix, pieces, ragged, span_hashes, trim, utf8, word_spans
from .components import connected_components
from .substring_dedup import sequence_hashes

SHINGLE, THRESHOLD = 5, (4, 5)  # 4/5
BANDS, ROWS, STEP = 32, 4, 32
TOLERANCE = 1e-9
#: Documents and shingles of a block of a large neighbourhood.
UNIT_DOCS, UNIT_SHINGLES = 512, 1_500_000
_rng = np.random.default_rng(20_011)
_XOR, _MULTIPLY = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))


def least_agreements(compared: int, threshold: float, tolerance: float = TOLERANCE) -> int:
    """The fewest agreements of `compared` values at which reaching the threshold is likelier than the tolerance."""
    total, n = 0.0, compared + 1
    for m in range(compared + 1):
        total += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return compared


def shingle_sets(data: np.ndarray, at: np.ndarray, key: tuple[int, ...], length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, joined, and the n+1 offsets."""
    starts, ends, words = word_spans(data, at)
    hashes, _ = span_hashes(data, starts, ends, key)
    runs = sequence_hashes(hashes, length)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= length:
            out.append(np.unique(runs[a : b - length + 1]))
        elif a < b:
            whole = hashes[a : a + 1]
            for k in range(a + 1, b):
                whole = join_hashes(whole, hashes[k : k + 1])
            out.append(whole)
        else:
            out.append(hashes[:0])
    sizes = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, 128) MinHash values of rows that have shingles; rows without any must not be given."""
    out = np.zeros((len(at) - 1, BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat((hashes ^ _XOR[k]) * _MULTIPLY[k], at[:-1]) >> np.uint64(32)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """(rows, 32) hashes of the bands."""
    s = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD, s.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out ^ (s[:, :, k] * _ODD + np.uint64(k)))
    return out


def set_ids(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """An id for each row's set: 128 bits over its sorted hashes."""
    whole = memoryview(np.ascontiguousarray(hashes)).cast("B")
    return [hashlib.blake2b(whole[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def describe(docs: DataFrame, key: tuple[int, ...], text: str = "text") -> DataFrame:
    """doc_id, text_hash, n (shingles), set_id and bands; the last two null where there are no shingles."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("__text"))

    def run(batches):
        for b in batches:
            for part, data, at in pieces(b, "__text"):
                hashes, ends = shingle_sets(data, at, key)
                n = np.diff(ends)
                full = np.flatnonzero(n)
                ids, bands = [None] * len(n), np.zeros((len(n), BANDS), np.uint64)
                if len(full):
                    own = np.concatenate([ends[:-1][full], ends[-1:]])
                    bands[full] = band_hashes(signatures(hashes, own))
                    for k, one in zip(full.tolist(), set_ids(hashes, own), strict=True):
                        ids[k] = one
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), lists], names=["doc_id", "text_hash", "n", "set_id", "bands"])
            trim()

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, set_id binary, bands array<long>")


def _agreeing(signature: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs survive the comparison of their MinHash values."""
    alive, agreed = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k in range(0, BANDS * ROWS, STEP):
        agreed = agreed + (signature[i[alive], k : k + STEP] == signature[j[alive], k : k + STEP]).sum(1)
        keep = agreed >= least_agreements(k + STEP, threshold)
        alive, agreed = alive[keep], agreed[keep]
    return alive


#: Pairs compared at once.
PAIRS_AT_ONCE = 1 << 15


def candidate_pairs(bands: np.ndarray, side: np.ndarray | None):
    """Yield arrays i < j of rows that share a band, each pair once, in the first band they share.

    With sides given, only pairs of different sides."""
    for k in range(bands.shape[1]):
        order = np.argsort(bands[:, k], kind="stable")
        b = bands[order, k]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        sizes = np.diff(np.append(first, len(b)))
        # Each place pairs with the later places of its group, a bounded number of pairs at a time.
        later = np.repeat(first + sizes, sizes) - np.arange(len(b)) - 1
        places = np.flatnonzero(later)
        upto = np.cumsum(later[places])
        start = 0
        while start < len(places):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
            p = places[start:end]
            i, j = order[np.repeat(p, later[p])], order[ragged(p + 1, later[p])]
            new = ~(bands[i, :k] == bands[j, :k]).any(1) if k else np.ones(len(i), bool)
            if side is not None:
                new &= side[i] != side[j]
            if new.any():
                yield np.minimum(i[new], j[new]), np.maximum(i[new], j[new])
            start = end


def verified(hashes: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs reach the threshold, by their sets; hashes are small consecutive numbers."""
    num, den = THRESHOLD
    n = np.diff(at)
    out = np.zeros(len(i), bool)
    # i / (a + b - i) >= num / den, in whole numbers; the smaller set bounds the overlap.
    possible = np.flatnonzero(np.minimum(n[i], n[j]) * (num + den) >= num * (n[i] + n[j]))
    possible = possible[np.argsort(i[possible], kind="stable")]
    mark = np.zeros(int(hashes.max()) + 1 if len(hashes) else 0, bool)
    heads = np.flatnonzero(np.append(True, np.diff(i[possible]) != 0)) if len(possible) else []
    for a, b in zip(heads, np.append(heads[1:], len(possible)) if len(possible) else [], strict=True):
        left = i[possible[a]]
        own = hashes[at[left] : at[left + 1]]
        mark[own] = True
        right = j[possible[a:b]]
        sizes = n[right]
        common = np.add.reduceat(mark[hashes[ragged(at[right], sizes)]].astype(np.int64), np.cumsum(sizes) - sizes)
        out[possible[a:b]] = common * (num + den) >= num * (n[left] + sizes)
        mark[own] = False
    return out


def _join_unit(table: pa.Table, key: tuple[int, ...]) -> pa.Table:
    """Links of one unit: for each document the weight of its partners and the root of its part."""
    text = table.column("__text").combine_chunks()
    data, at = utf8(text)
    ids = table.column("set_id").to_pylist()
    weight = table.column("copies").to_numpy()
    block = table.column("block").to_numpy()
    first, second = table.column("first_block")[0].as_py(), table.column("second_block")[0].as_py()
    hashes, ends = shingle_sets(data, at, key)
    signature = signatures(hashes, ends)
    links, root = np.zeros(len(ids), np.int64), list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    small = np.unique(hashes, return_inverse=True)[1]
    for i, j in candidate_pairs(band_hashes(signature), block if first != second else None):
        alive = _agreeing(signature, i, j, THRESHOLD[0] / THRESHOLD[1])
        i, j = i[alive], j[alive]
        linked = verified(small, ends, i, j)
        i, j = i[linked], j[linked]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        for a, b in set(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if len(hashes) > 100_000:
        trim()
    roots = [ids[find(k)] for k in range(len(ids))]
    return pa.table({"set_id": pa.array(ids, pa.binary()), "links": pa.array(links), "root": pa.array(roots, pa.binary())})


def join(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash, class_id, n_links, n_copies and first: whether the row stands for its class.

    class_id is the smallest doc_id of the documents that links connect; n_links counts the other documents
    whose similarity is at least 4/5, copies of the document among them; n_copies those with its shingle set."""
    bounded_batches(docs.sparkSession)
    key = fresh_key()
    rows = materialize(describe(docs, key, text), "shingles")
    sets = rows.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.count("*").alias("copies"), F.max("n").alias("n"), F.any_value("bands").alias("bands"))
    # 64 bits of the id are enough to name neighbourhoods: two sets that share them only share one.
    sets = materialize(sets.withColumn("short", F.xxhash64("set_id")), "sets")
    bands = sets.select("short", F.explode("bands").alias("band"))
    sets = sets.drop("bands")
    least = bands.groupBy("band").agg(F.min("short").alias("v"), F.max("short").alias("w")).filter("v <> w").select(F.col("band").alias("__band"), "v")
    edges = bands.join(least, F.col("band") == F.col("__band")).select(F.col("short").alias("u"), "v").filter("u <> v").distinct()
    near = connected_components(edges, "neighbourhoods").select(F.col("node").alias("short"), F.col("root").alias("part"))
    near = materialize(near.join(sets, "short"), "near")
    amount = near.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / UNIT_DOCS), F.ceil(F.sum("n") / UNIT_SHINGLES)).cast("int").alias("blocks")).withColumnRenamed("part", "__part")
    units = near.join(amount, F.col("part") == F.col("__part")).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("set_id", "copies", "part", "block", F.least("block", "other").alias("first_block"), F.greatest("block", "other").alias("second_block"), F.col("head.doc_id").alias("__id"), F.col("head.text_hash").alias("__hash"))
    texts = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64(text).alias("__text_hash"), F.col(text).alias("__text"))
    # One row for each head, though rows may repeat.
    wanted = near.select(F.col("head.doc_id").alias("__id"), F.col("head.text_hash").alias("__hash"))
    # The heads grow with the documents, so they are not to be broadcast while they happen to be few.
    wanted = wanted.hint("shuffle_merge")
    texts = texts.join(wanted, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi").dropDuplicates(["__doc", "__text_hash"])
    work = units.join(texts, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")))
    work = work.select("part", "first_block", "second_block", "block", "set_id", "copies", "__text")
    found = work.groupBy("part", "first_block", "second_block").applyInArrow(lambda t: _join_unit(t, key), "set_id binary, links long, root binary")
    found = materialize(found, "links")
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("root <> set_id").select(F.col("set_id").alias("u"), F.col("root").alias("v")), "classes")
    of_class = sets.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")).join(links, "set_id", "left")
    of_class = materialize(of_class.select("set_id", "root", "head", "copies", F.coalesce("links", F.lit(0)).alias("links")), "class-parts")
    named = of_class.groupBy("root").agg(F.min("head").alias("class_head")).withColumnRenamed("root", "__root")
    named = of_class.join(named, F.col("root") == F.col("__root")).select(F.col("set_id").alias("__set"), "class_head", "copies", "links")
    out = rows.join(named, F.col("set_id") == F.col("__set"), "left")
    mine = F.struct("doc_id", "text_hash")
    return out.select(
        "doc_id",
        "text_hash",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_head.doc_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("set_id").isNull() | (mine == F.col("class_head"))).alias("first"),
    )


def first_of_each_class(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stand for their classes, with their own columns; of repeated rows one stays."""
    firsts = join(docs, text).filter("first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    rows = docs.withColumn("__own", F.xxhash64(text))
    # The ids grow with the documents; they are not to be broadcast while they happen to be few.
    kept = rows.join(firsts.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__own"]).select(*docs.columns)
