"""Documents packed into blocks, and a two-way exchange of hashes between blocks.

A block is one row: some MB of texts, compressed, with their other columns. A block sends each hash once, in
sorted slices by hash range, to the range's bucket; the bucket answers with one value for each hash sent, in
the same order. So a passage that a third of all documents hold costs one entry a block, no group is ever
gathered, and answers are small. Blocks, and answers, are written to the shared folder: a lost executor costs
the tasks it ran.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, buckets_for, materialize, pieces, trim, utf8

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: What goes with a hash: the doc_id of its first document in the block, and a second hash of the same bytes.
DOC = np.dtype([("doc", "<i8"), ("check", "<u8")])
#: Bytes of texts, or of messages, in a task.
TASK_BYTES = 24 << 20
NULL_ID = np.iinfo(np.int64).min

BLOCK_SCHEMA = "block_id long, n_bytes long, rest binary, sizes binary, data binary, marks binary"
MESSAGE_SCHEMA = "bucket int, block_id long, hashes binary, extra binary"
ANSWER_SCHEMA = "block_id long, bucket int, answer binary"


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(1).compress(sink.getvalue().to_pybytes())


def pack(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", label: str = "blocks", mark: Callable[[np.ndarray, np.ndarray], bytes] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents, each in order of doc_id (null first). Null texts are empty.

    mark(bytes, row offsets) may find what all later passes need; it is kept with the block."""
    bounded_batches(docs.sparkSession)
    names = list(keep)
    rows = docs.select(*names, F.col(text).alias("__text"))

    def emit(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        ids = table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        table = table.take(pa.array(np.argsort(ids, kind="stable"))).combine_chunks()
        data, at = utf8(table.column(len(names)).combine_chunks() if table.num_rows else pa.array([], pa.string()))
        block = (TaskContext.get().partitionId() << 32) + number
        packed = zstandard.ZstdCompressor(3).compress(data.tobytes())
        return pa.RecordBatch.from_pydict({"block_id": [block], "n_bytes": [len(data)], "rest": [_ipc(table.select(names))], "sizes": [np.diff(at).tobytes()], "data": [packed], "marks": [zstandard.ZstdCompressor(1).compress(mark(data, at)) if mark else b""]})

    def run(batches):
        parts, size, number = [], 0, 0
        for b in batches:
            for part, data, _ in pieces(b, "__text", block_bytes):
                if parts and size + len(data) > block_bytes:
                    yield emit(parts, number)
                    parts, size, number = [], 0, number + 1
                    trim()
                parts.append(part)
                size += len(data)
        if parts:
            yield emit(parts, number)

    return materialize(rows.mapInArrow(run, BLOCK_SCHEMA), label)


class Block:
    """A block's texts: bytes, row offsets, doc_id of each row, and the other columns."""

    def __init__(self, row: dict):
        self.id = row["block_id"]
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
        self.marks = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["marks"]), np.uint8) if row["marks"] else np.zeros(0, np.uint8)
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(row["rest"])) as r:
            self.rest = r.read_all()
        self.ids = self.rest.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False) if self.rest.num_rows else np.zeros(0, np.int64)

    def beside(self, schema: pa.Schema, *columns) -> pa.Table:
        """The block's other columns, and beside them new ones, as a table of the schema."""
        arrays = [c.combine_chunks() for c in self.rest.columns] + list(columns)
        return pa.Table.from_arrays([(a if isinstance(a, pa.Array) else pa.array(a, f.type)).cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def text_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_bytes")).first()[0] or 0


def n_tasks(n_bytes: float) -> int:
    """Tasks for so many bytes, so that none grows with the table."""
    return max(8, -(-int(n_bytes) // TASK_BYTES))


def slices(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket's range begins among sorted hashes; n+1 offsets."""
    edges = np.array([-((-k << 64) // n) for k in range(n)], np.uint64)
    return np.concatenate([np.searchsorted(hashes, edges), [len(hashes)]])


def messages(block_id: int, n: int, hashes: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """A block's sorted hashes as one message to each bucket that gets any; extra goes with the hashes."""
    at = slices(hashes, n)
    full = [k for k in range(n) if at[k] < at[k + 1]]
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(full, pa.int32()),
            "block_id": pa.array([block_id] * len(full), pa.int64()),
            "hashes": pa.array([hashes[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()),
            "extra": pa.array([extra[at[k] : at[k + 1]].tobytes() if extra is not None else b"" for k in full], pa.binary()),
        }
    )


def per_block(blocks: DataFrame, f: Callable[[Block], pa.RecordBatch], schema) -> DataFrame:
    bounded_batches(blocks.sparkSession)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                yield f(Block(row))
                trim()

    return blocks.mapInArrow(run, schema)


def answered(sent: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], label: str, buckets: int, extra_type=DOC) -> DataFrame:
    """Each bucket's answers: f(hashes, extra, block number) gives one byte for each entry of the bucket."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block_id"])
        parts = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        sizes = np.array([len(p) for p in parts])
        extra = np.concatenate([np.frombuffer(r["extra"], extra_type) for r in rows])
        out = f(np.concatenate(parts), extra, np.repeat(np.arange(len(rows)), sizes)).astype(np.uint8)
        ends = np.cumsum(sizes)
        trim()
        return pa.table({"block_id": pa.array([r["block_id"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "answer": pa.array([zstandard.ZstdCompressor(1).compress(out[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    return materialize(sent.repartition(-(-buckets // 2), "bucket").groupBy("bucket").applyInArrow(run, ANSWER_SCHEMA), label)


def with_answers(blocks: DataFrame, answers: list[DataFrame], f: Callable[..., pa.RecordBatch | pa.Table], schema, tasks: int) -> DataFrame:
    """f(block, answer of the first exchange, of the second, ...) for every block, answers in the order sent."""
    everything = None
    for k, a in enumerate(answers):
        a = a.withColumn("step", F.lit(k))
        everything = a if everything is None else everything.unionByName(a)
    n = len(answers)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[list] = [[] for _ in range(n)]
        for r in right.to_pylist():
            got[r["step"]].append((r["bucket"], r["answer"]))
        parts = [b"".join(zstandard.ZstdDecompressor().decompress(x) for _, x in sorted(g)) for g in got]
        out = f(Block(left.to_pylist()[0]), *(np.frombuffer(p, np.uint8) for p in parts))
        trim()
        return out if isinstance(out, pa.Table) else pa.Table.from_batches([out])

    own, theirs = (x.repartition(tasks, "block_id").groupBy("block_id") for x in (blocks, everything))
    return own.cogroup(theirs).applyInArrow(run, schema)
