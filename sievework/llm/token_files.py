"""Token-id output: texts tokenized with the tokenizers library, written as rANS files in order of doc_id.

Documents are dealt by ranges of doc_id and sorted; each task writes files of some million ids, rows of a table
in the shared folder. The files' totals give the ids before each file, so all files are read in parallel.

Defined results: null text is empty and has the end id alone; null doc_id comes first; rows
that repeat a doc_id follow each other in an order that their texts fix; an empty table gives no files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rans
from .common import materialize, pieces, bounded_batches
from .word_cache import WordCache

FILE_IDS = 1 << 22


_made: dict[str, WordCache] = {}


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, text: str = "text") -> DataFrame:
    """The files: part, number (their order), n_docs, n_ids and file."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("__text"))
    names = ["part", "number", "n_docs", "n_ids", "file"]

    def run(batches):
        words = _made.get(tokenizer_path) or _made.setdefault(tokenizer_path, WordCache(tokenizer_path))
        held, size, number = [], 0, 0

        def flush():
            doc_ids, known, counts, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            file = rans.write_file(doc_ids, known, counts, ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "file": pa.array([file], pa.binary())})

        for b in batches:
            for part, data, at in pieces(b, "__text"):
                ids, counts = words.encode(data, at, end_id)
                column = part.column(0)
                held.append((column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False), counts, ids))
                size += len(ids)
                if size >= FILE_IDS:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return materialize(rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, ("int", "int", "long", "long", "binary"), strict=True))), "token-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    return _read(files, "ids", "binary", lambda x: x, pa.binary())


def digests(files: DataFrame) -> DataFrame:
    """The contract's columns."""
    return _read(files, "ids_crc32", "long", zlib.crc32, pa.int64())


def _read(files: DataFrame, name: str, kind: str, of, arrow: pa.DataType) -> DataFrame:
    bounded_batches(files.sparkSession)
    # One row for each file of some million ids.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    rows = files.join(starts, ["part", "number"]).select("start", "file")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                file = rans.File(r["file"])
                ids = file.ids().astype("<u4").tobytes()
                ends = np.cumsum(file.counts)
                begins = ends - file.counts
                values = [of(ids[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, mask=~file.known), pa.array(begins + r["start"]), pa.array(file.counts), pa.array(values, arrow)], names=["doc_id", "start", "n_tokens", name])

    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}")
