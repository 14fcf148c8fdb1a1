"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are cut at safe boundaries before the library sees them: before a single space that follows a
non-space and precedes a non-space. No alternative of the pattern matches across such a place, so the ids
of the pieces, joined, are the ids of the whole; a very long text costs no more than many short ones.
Decoding joins the raw bytes of the ids, so a text cut inside a character survives as well.

Defined results: null text is empty text; empty text has no ids and decodes to no bytes; ids out of range
raise; repeated rows give repeated rows; other columns are ignored by `encode` unless listed in `keep`.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trim

#: Characters of a text that go to the library at once.
PIECE_CHARS = 50_000
_SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")


class ByteBPE:
    """An encoder over one rank file; ranks and pattern are those of the file's tokenizer."""

    def __init__(self, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    @staticmethod
    def cut(text: str, limit: int = PIECE_CHARS) -> list[str]:
        """Pieces of about `limit` characters, cut at safe boundaries only."""
        out, start = [], 0
        while len(text) - start > limit:
            found = _SAFE.search(text, start + limit)
            if not found:
                break
            out.append(text[start : found.start()])
            start = found.start()
        return [*out, text[start:]]

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PIECE_CHARS:
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        return np.concatenate([np.array(self.encoding.encode_ordinary(x), np.uint32) for x in self.cut(text)])

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])


_made: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(rank_path: str, pattern: str) -> ByteBPE:
    """One encoder for each file and worker process."""
    if (rank_path, pattern) not in _made:
        _made[rank_path, pattern] = ByteBPE(rank_path, pattern)
    return _made[rank_path, pattern]


def encode(docs: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep`, and ids: little-endian unsigned 32-bit integers, binary."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = kept.select(*keep, F.lit(b"").alias("ids")).schema

    def run(batches):
        bpe = tokenizer(rank_path, pattern)
        for b in batches:
            ids = [bpe.encode(t or "").astype("<u4").tobytes() for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())], names=[*keep, "ids"])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256, and the decoded bytes."""
    kept = encoded.select(*keep, "ids")
    schema = kept.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit(b"").alias("decoded")).schema

    def run(batches):
        bpe = tokenizer(rank_path, pattern)
        for b in batches:
            raw = b.column(len(keep)).to_pylist()
            n = pa.array([len(x) // 4 for x in raw], pa.int64())
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())
            out = pa.array([bpe.decode(np.frombuffer(x, "<u4")) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n, sha, out], names=[*keep, "n_tokens", "ids_sha256", "decoded"])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256 and decoded_sha256: `encode` and `decode` in one pass, without the ids."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = kept.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches):
        bpe = tokenizer(rank_path, pattern)
        for b in batches:
            rows = []
            for t in b.column(len(keep)).to_pylist():
                raw = bpe.encode(t or "").astype("<u4").tobytes()
                rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(bpe.decode(np.frombuffer(raw, "<u4"))).hexdigest()))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=schema.names)
            trim()

    return kept.mapInArrow(run, schema)
