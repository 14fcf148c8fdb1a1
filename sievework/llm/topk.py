"""Exact top-k search by inner product: a KD-tree for each shard of vectors.

Vectors become whole numbers, floor(256 x), in shards of some thousand rows, kept in 16 bits a component where they
fit. A shard is split at medians of its widest dimension down to small leaves; every node keeps the tight box around
its vectors. No vector x in a box scores more than sum(max(q * low, q * high)) with a query q, so a node is left out
for the queries whose k-th best score already exceeds that. Queries travel in blocks: the tree is searched best first,
by the largest gap between bound and k-th score, for all queries of a block that the node may still serve. A leaf
takes one matrix product; only rows whose largest score reaches the k-th are looked at further.

Every query is first searched in its own shard; the k-th score found there travels with it. Shards form units of up to
HELD bytes, and a task holds the trees of one: each block of queries comes to a unit once, and carries its best
scores from shard to shard there. Units are as many as let the copies of the queries weigh COPIES times the vectors.
Where there are many, some are searched first, and the k-th scores found there travel to the others. Each unit yields
only what may be among the best; a window keeps the best k of all units.

Defined results: vectors null, or with null or non-finite components, neither ask nor answer; vectors meet
those of their own length only; rows with the query's vec_id are its own and no candidates; a null vec_id is no
query and, as a candidate, comes last among ties; repeated rows are candidates, and queries, each; equal scores go
to the smaller vec_id; fewer candidates than k give fewer rows; an empty table gives an empty table. Scores
are exact: products of 32-bit floats while every sum stays below 2^24, of 64-bit floats below 2^53, and Python
integers beyond that; a score that does not fit a long raises an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, bounded_batches

SCALE = 256
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 16384, 512, 2048
#: Bytes that a shard takes at most as 64-bit floats: long vectors make shards of fewer rows.
SHARD_BYTES = 16 << 20
#: Bytes of shards that a task holds at most, and at least where the table has them; copies of the queries' bytes in between.
HELD, UNIT_BYTES, COPIES = 64 << 20, 2 << 20, 2
#: From so many units on, one in so many is searched before the others, which then start from the k-th scores found there.
ROUNDS = 8
NO_ID = np.iinfo(np.int64).max
PACKED = "kind int, dim int, uid long, n int, ids binary, vectors binary, bounds binary"
SMALL = np.iinfo(np.int16).max


class Block:
    """Queries, and the k best scores met so far for each; bounds are k-th scores known from elsewhere."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int):
        self.vectors, self.ids, self.k = vectors, ids, k
        self.largest = _largest(vectors)
        self.kth = bounds.astype(np.float64)
        self.values, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), NO_ID)
        #: Among scores that equal the k-th, the largest id that may still be among the best.
        self.last = np.full(len(ids), NO_ID)
        self._as = {}

    def floats(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries, and their parts above and below 0, as floats of a kind."""
        if kind not in self._as:
            x = self.vectors.astype(kind)
            self._as[kind] = x, np.maximum(x, 0), np.minimum(x, 0)
        return self._as[kind]

    def take(self, asking: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in what is among the best of the scores of the vectors `ids` (rows) with the queries `asking` (columns)."""
        hit = np.flatnonzero(scores.max(0) >= self.kth[asking])
        if not len(hit):
            return
        asking, scores = asking[hit], np.ascontiguousarray(scores[:, hit].T)
        scores[ids[None, :] == self.ids[asking, None]] = -np.inf
        least = self.kth[asking, None]
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, -self.k, None])
        may = (scores >= least) & (scores > -np.inf)
        may &= (scores > self.kth[asking, None]) | (ids[None, :] <= self.last[asking, None])
        row, column = np.nonzero(may)
        if not len(row):
            return
        hit = np.unique(row)
        touched = asking[hit]
        q = np.concatenate([np.repeat(touched, self.k), asking[row]])
        found = np.concatenate([self.found[touched].ravel(), ids[column]])
        values = np.concatenate([self.values[touched].ravel(), scores[row, column].astype(np.float64)])
        order = np.lexsort((found, -values, q))
        first = np.flatnonzero(np.append(True, np.diff(q[order]) != 0))
        best = order[first[:, None] + np.arange(self.k)]  # as many as k of each there are: they had k, if only -inf
        self.values[touched], self.found[touched] = values[best], found[best]
        kth = self.values[touched, -1]
        self.last[touched] = np.where(kth >= self.kth[touched], self.found[touched, -1], NO_ID)
        self.kth[touched] = np.maximum(self.kth[touched], kth)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, id and score of what was taken in."""
        row, column = np.nonzero(self.values > -np.inf)
        return row, self.found[row, column], self.values[row, column].astype(np.int64)


def _largest(vectors: np.ndarray) -> float:
    return max(float(vectors.max()), -float(vectors.min())) if vectors.size else 0.0


class Tree:
    """A KD-tree over the rows of a matrix of whole numbers; rows are kept in the order of the leaves."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(ids))
        self.vectors, self.nodes = vectors, []
        if len(ids):
            self._split(0, len(ids))
        self.packed, self.ids = vectors[self.order], ids[self.order]
        self.largest = _largest(vectors)
        self.kind = np.float32 if self.packed.dtype == np.int16 else np.float64
        self.vectors = self.packed.astype(self.kind)
        self.low = np.array([self.vectors[a:b].min(0) for a, b, _, _ in self.nodes])
        self.high = np.array([self.vectors[a:b].max(0) for a, b, _, _ in self.nodes])

    def _split(self, a: int, b: int) -> int:
        me = len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        if b - a > LEAF_ROWS:
            middle = (b - a) // 2
            if self.vectors.shape[1]:
                own = self.vectors[self.order[a:b]]
                along = own[:, int(np.argmax(own.max(0).astype(np.float64) - own.min(0)))]
                self.order[a:b] = self.order[a:b][np.argpartition(along, middle)]
            left = self._split(a, a + middle)
            self.nodes[me] = (a, b, left, self._split(a + middle, b))
        return me

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, list] | None:
        """Take what is among the best into the block; where floats cannot hold the scores, give row, id and score instead."""
        if not len(block.ids) or not self.nodes:
            return None
        sums = block.largest * self.largest * max(1, block.vectors.shape[1])
        if sums >= 1 << 53:
            return self._search_integers(block.vectors, block.ids, block.k)
        kind = np.float32 if sums < 1 << 24 else np.float64
        queries, up, down = block.floats(kind)
        vectors, low, high = (x.astype(kind, copy=False) for x in (self.vectors, self.low, self.high))
        most = high @ up.T + low @ down.T
        heap = [(0.0, 0, np.arange(len(queries)))]
        while heap:
            _, node, asking = heapq.heappop(heap)
            asking = asking[most[node, asking] >= block.kth[asking]]
            if not len(asking):
                continue
            a, b, left, right = self.nodes[node]
            if left < 0:
                block.take(asking, vectors[a:b] @ (queries if len(asking) == len(queries) else queries[asking]).T, self.ids[a:b])
                continue
            for child in (left, right):
                gap = most[child, asking] - block.kth[asking]
                may = gap >= 0
                if may.any():
                    heapq.heappush(heap, (-float(gap.max()), child, asking[may]))
        return None

    def _search_integers(self, queries: np.ndarray, own: np.ndarray, k: int):
        """Without bounds, in Python integers, for components too large for exact floats."""
        rows, ids, values = [], [], []
        whole = [[int(x) for x in v] for v in self.packed]
        for r, q in enumerate(queries):
            q = [int(x) for x in q]
            best = heapq.nsmallest(k, ((-sum(x * y for x, y in zip(q, v, strict=True)), int(i)) for v, i in zip(whole, self.ids, strict=True) if i != own[r]))
            for s, i in best:
                if not -(1 << 63) <= -s < 1 << 63:
                    raise OverflowError("a score does not fit a long")
                rows.append(r), ids.append(i), values.append(-s)
        return np.array(rows, np.int64), np.array(ids, np.int64), values


def _row(kind: int, dim: int, uid: int, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray) -> dict:
    return {"kind": kind, "dim": dim, "uid": uid, "n": len(ids), "ids": ids.astype(np.int64).tobytes(), "vectors": np.ascontiguousarray(vectors).tobytes(), "bounds": bounds.astype(np.float64).tobytes()}


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors (of 16 bits a component, or floats of 64) and bounds."""
    ids = np.frombuffer(r["ids"], np.int64)
    kind = np.int16 if len(r["vectors"]) == 2 * len(ids) * r["dim"] else np.float64
    return ids, np.frombuffer(r["vectors"], kind).reshape(len(ids), r["dim"]), np.frombuffer(r["bounds"], np.float64)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.int32()), ("dim", pa.int32()), ("uid", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("bounds", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _parts(vectors: DataFrame) -> int:
    return max(1, -(-vectors.count() // SHARD_ROWS))


def pack(vectors: DataFrame, is_query: Column, k: int, parts: int | None = None) -> DataFrame:
    """Shards (kind 0) and, with their bounds from their own shard, the queries of each shard (kind 1); a uid's upper half is one of `parts`."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    parts = parts or _parts(vectors)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))

    def emit(dim: int, uid: int, held: list) -> pa.RecordBatch:
        ids, x, asks = (np.concatenate(c) for c in zip(*held, strict=True))
        tree = Tree(x, ids)
        out = [_row(0, dim, uid, tree.ids, tree.packed, np.zeros(0))]
        q = np.flatnonzero(asks)
        bounds = [np.zeros(0)]
        for a in range(0, len(q), QUERY_ROWS):
            some = q[a : a + QUERY_ROWS]
            block = Block(x[some], ids[some], np.full(len(some), -np.inf), k)
            more = tree.search(block)
            if more:
                row, _, values = more
                for r in np.flatnonzero(np.bincount(row, minlength=len(some)) >= k):
                    block.kth[r] = float(min(v for v, at in zip(values, row, strict=True) if at == r))
            bounds.append(block.kth)
        return _batch([*out, _row(1, dim, uid, ids[q], x[q], np.concatenate(bounds))] if len(q) else out)

    def run(batches):
        held, sizes, number = {}, {}, 0
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            asks = b.column(2).to_numpy(zero_copy_only=False)
            lists = b.column(1)
            n = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])
            for dim in np.unique(n[n >= 0]).tolist():
                mine = np.flatnonzero(n == dim)
                x = flat[at[mine][:, None] + np.arange(dim)].reshape(len(mine), dim)
                fine = np.isfinite(x).all(1)
                x = np.floor(SCALE * x[fine])
                mine = mine[fine]
                small = np.abs(x).max(1, initial=0) <= SMALL
                most = max(LEAF_ROWS, min(SHARD_ROWS, SHARD_BYTES // (8 * max(1, dim))))
                for key, which in (((dim, 2), small), ((dim, 8), ~small)):
                    of, y = mine[which], x[which].astype(np.int16 if key[1] == 2 else np.float64)
                    for a in range(0, len(of), most):
                        part = of[a : a + most]
                        if sizes.get(key, 0) + len(part) > most:
                            yield emit(dim, (TaskContext.get().partitionId() << 32) + number, held.pop(key))
                            sizes[key], number = 0, number + 1
                        held.setdefault(key, []).append((ids[part], y[a : a + most], asks[part]))
                        sizes[key] = sizes.get(key, 0) + len(part)
        for (dim, _), parts_ in held.items():
            yield emit(dim, (TaskContext.get().partitionId() << 32) + number, parts_)
            number += 1

    return materialize(rows.repartition(parts).mapInArrow(run, PACKED), "shards")


def _merged(queries: DataFrame) -> DataFrame:
    """The queries in blocks of QUERY_ROWS, and of what is left over in a task."""
    n = queries.agg(F.sum("n")).first()[0] or 0

    def run(batches):
        held, made = {}, 0
        for b in batches:
            for r in b.to_pylist():
                new = _unpack(r)
                key = r["dim"], new[1].dtype.itemsize
                held.setdefault(key, []).append(new)
                if sum(len(x[0]) for x in held[key]) >= QUERY_ROWS:
                    ids, x, bounds = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
                    whole = len(ids) // QUERY_ROWS * QUERY_ROWS
                    for a in range(0, whole, QUERY_ROWS):
                        made += 1
                        yield _block(made, key[0], *(c[a : a + QUERY_ROWS] for c in (ids, x, bounds)))
                    if whole < len(ids):
                        held[key] = [(ids[whole:], x[whole:], bounds[whole:])]
        for (dim, _), rows in held.items():
            made += 1
            yield _block(made, dim, *(np.concatenate(c) for c in zip(*rows, strict=True)))

    def _block(made: int, dim: int, ids: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        return _batch([_row(1, dim, (TaskContext.get().partitionId() << 32) + made, ids, x, bounds)])

    return materialize(queries.repartition(max(1, -(-n // QUERY_ROWS))).mapInArrow(run, PACKED), "queries")


def _units(packed: DataFrame, parts: int) -> DataFrame:
    """For each length of vector: how many parts a unit has (`each`), the number of units, and of those searched first."""
    weight = F.octet_length("vectors") + F.octet_length("ids")
    sizes = packed.groupBy("dim").agg(F.sum(F.when(F.col("kind") == 0, weight).otherwise(0)).alias("shards"), F.sum(F.when(F.col("kind") == 1, weight).otherwise(0)).alias("queries"))
    by_copies = F.floor(COPIES * F.col("shards") / F.greatest("queries", F.lit(1)))
    units = F.greatest(F.ceil(F.col("shards") / max(1, HELD)), F.least(by_copies, F.ceil(F.col("shards") / UNIT_BYTES)), F.lit(1))
    each = F.ceil(F.lit(parts) / F.least(units, F.lit(parts))).cast("long")
    units = sizes.select("dim", each.alias("each")).withColumn("units", F.ceil(F.lit(parts) / F.col("each")).cast("long"))
    return units.withColumn("first", F.when(F.col("units") < ROUNDS, F.col("units")).otherwise(F.ceil(F.col("units") / ROUNDS)).cast("long"))


def _bounded(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The blocks of queries with the k-th scores of `found` as bounds."""
    kth = found.filter(F.col("rank") == k).groupBy(F.col("block").alias("uid")).agg(F.collect_list("row").alias("rows"), F.collect_list("score").alias("scores"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, x, bounds = _unpack(r)
                if r["rows"]:
                    bounds = bounds.copy()
                    at = np.array(r["rows"])
                    bounds[at] = np.maximum(bounds[at], np.array(r["scores"], np.float64))
                yield _batch([_row(1, r["dim"], r["uid"], ids, x, bounds)])

    return materialize(blocks.join(kth, "uid", "left").mapInArrow(run, PACKED), "queries")


def search(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query; vectors has vec_id and embedding."""
    parts = _parts(vectors)
    packed = pack(vectors, is_query, k, parts)
    bounded_batches(packed.sparkSession)
    units = materialize(_units(packed, parts), "units")
    tasks, more = units.agg(F.max("units"), F.max(F.col("units") - F.col("first"))).first()
    columns = ["dim", "unit", "kind", "uid", "ids", "vectors", "bounds"]
    best = Window.partitionBy("block", "row").orderBy(F.col("score").desc(), "vec_id")

    def run(batches):
        at, trees = None, []
        for b in batches:
            for r in b.to_pylist():
                if at != (r["dim"], r["unit"]):
                    at, trees = (r["dim"], r["unit"]), []
                ids, x, bounds = _unpack(r)
                if r["kind"] == 0:
                    trees.append(Tree(x, ids))
                    continue
                block = Block(x, ids, bounds, k)
                beyond = [m for m in (tree.search(block) for tree in trees) if m]
                for row, found, values in [block.rows(), *beyond]:
                    yield pa.RecordBatch.from_arrays([pa.array([r["uid"]] * len(row), pa.int64()), pa.array(row, pa.int32()), pa.array(ids[row], pa.int64()), pa.array(found, pa.int64()), pa.array(values, pa.int64())], names=["block", "row", "query_id", "vec_id", "score"])

    def searched(blocks: DataFrame, low: Column, high: Column) -> DataFrame:
        """What each of the units low .. high - 1 yields for each block."""
        shards = packed.filter("kind = 0").join(F.broadcast(units), "dim").withColumn("unit", F.floor(F.shiftright("uid", 32) / F.col("each")))
        shards = shards.filter((F.col("unit") >= low) & (F.col("unit") < high))
        asked = blocks.join(F.broadcast(units), "dim").filter(low < high).withColumn("unit", F.explode(F.sequence(low, high - 1)))
        # A unit for each task; units of other lengths of vectors begin at another task.
        dealt = shards.select(columns).unionByName(asked.select(columns)).repartitionById(tasks or 1, F.pmod(F.col("unit") + F.abs(F.hash("dim")), F.lit(tasks or 1)).cast("int"))
        return dealt.sortWithinPartitions("dim", "unit", "kind", "uid").mapInArrow(run, "block long, row int, query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    blocks = _merged(packed.filter("kind = 1"))
    found = ranked(searched(blocks, F.lit(0).cast("long"), F.col("first")))
    if more:
        found = materialize(found, "first")
        found = ranked(found.drop("rank").unionByName(searched(_bounded(blocks, found, k), F.col("first"), F.col("units"))))
    return found.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
