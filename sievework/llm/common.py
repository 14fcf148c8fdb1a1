"""Plumbing that the training-data operators share."""

from __future__ import annotations

import ctypes
import hashlib
import re
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an Arrow operator works on at once; a longer document is worked on alone.
PIECE_BYTES = 1 << 20
#: What the contracts call white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD_RE = r"[^\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, alike for all operators: a batch of long texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where all run in one process, as in tests, one of our own serves."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or f"{tempfile.gettempdir()}/sievework"


#: Paths written and not yet deleted, with those of each open `scratch` in a list of its own.
_written: list[list[str]] = [[]]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Delete what materialize() wrote; results that still read it can no longer be computed."""
    for paths in _written:
        delete(spark, paths)
        paths.clear()


@contextmanager
def scratch(spark: SparkSession):
    """Delete what is materialized inside once the block ends, but for the tables given to the function that it yields."""
    _written.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(p for p in _written[-1] if any(p.split("/")[-1] in f for f in df.inputFiles()))
        return df

    try:
        yield keep
    finally:
        mine = _written.pop()
        delete(spark, [p for p in mine if p not in kept])
        _written[-1].extend(kept)


def trim() -> None:
    """Give memory that is no longer used back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim
    _libc = None


def folded(docs: DataFrame) -> tuple[DataFrame, Callable[[str], list[Column]]]:
    """doc_id, text, and all columns but text in the column `others`, so that no name of theirs meets an operator's;
    and a function that gives the columns back, with the text from the column it names."""
    names = docs.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("others")

    def back(text: str) -> list[Column]:
        return [F.col(text).alias("text") if c == "text" else F.col("others").getField(c).alias(c) for c in names]

    return docs.select("doc_id", "text", rest), back


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and the n+1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch between rows so that each piece holds about `limit` bytes of `column` at most."""
    whole = batch.column(batch.schema.get_field_index(column))
    _, at = utf8(whole)
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        part = batch.slice(start, end - start)
        yield part, *utf8(part.column(part.schema.get_field_index(column)))
        start = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i]+lengths[i]-1 of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the rows, and the n+1 word offsets of the rows; words never cross rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[(at > 0) & (at < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A span of this many bytes is held whole in its two numbers.
_HELD = 15


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each byte span, which different spans do not share: the bytes themselves and their
    number, up to 15 bytes; beyond that, 120 bits of a BLAKE2 digest under a mark of its own."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(len(data) + 9, "<u8", padded, 0, (1,))
    low = words[starts] & _MASK[np.minimum(size, 8)]
    high = words[starts + 8 * (size > 8)] & _MASK[np.clip(size - 8, 0, 7)] | np.minimum(size, _HELD).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > _HELD)
    if len(long):
        view = memoryview(padded)
        digests = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[long], high[long] = pairs[:, 0], pairs[:, 1] | np.uint64(0xFF << 56)
    return low, high


def fresh_key() -> tuple[int, ...]:
    """Odd numbers that no text can know: drawn by the driver for each run, alike in all of its tasks."""
    return tuple(secrets.randbits(64) | 1 for _ in range(4))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte span: a keyed permutation of its two numbers, so that both are equal for equal spans only."""
    k = [np.uint64(x) for x in key]
    left, right = span_numbers(data, starts, ends)
    left = left ^ mix(right * k[0] + k[1])
    right = right ^ mix(left * k[2] + k[3])
    return left ^ mix(right * k[1] + k[2]), right


def join_hashes(left: np.ndarray, right: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of a sequence from those of its two halves."""
    return mix(left * _LANES[lane] + (right ^ _ODD))


_LANES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def buckets_for(n_bytes: int, each: int = 12 << 20) -> int:
    return max(8, -(-n_bytes // each))
