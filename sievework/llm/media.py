"""Media columns: texts stored as lossless WebP, read back as pixels, with digests and features.

A payload of more than webp.ROWS rows becomes several files, one after the other; each RIFF header tells its size.
Files are written and read some MB at a time, so a very long text takes memory for a few copies of itself only.

Defined results: null text is empty text; an empty text is one row of bytes 255; repeated rows give repeated
rows with equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import bounded_batches, materialize, pieces, trim

PAD = 255
#: Bytes of payload that are coded together.
BATCH_BYTES = 1 << 21
_MOST = webp.ROW * webp.ROWS


def to_media(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The media bytes of each row: its bytes, padded with 255 to a positive multiple of ROW."""
    sizes = np.diff(at)
    full = np.maximum(1, -(-sizes // webp.ROW)) * webp.ROW
    out: list[list[bytes]] = [[] for _ in sizes]
    held, owners, size = [], [], 0

    def flush():
        parts = webp.encode_payloads(np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])]))
        for owner, part in zip(owners, parts, strict=True):
            out[owner].append(part)

    for k, (a, b, n) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), full.tolist(), strict=True)):
        for x in range(0, n, _MOST):
            part = data[a + x : min(b, a + x + _MOST)]
            want = min(_MOST, n - x)
            held.append(part if len(part) == want else np.concatenate([part, np.full(want - len(part), PAD, np.uint8)]))
            owners.append(k)
            size += want
            if size >= BATCH_BYTES:
                flush()
                held, owners, size = [], [], 0
    if held:
        flush()
    return [b"".join(x) for x in out]


def split_files(media: bytes) -> list[bytes]:
    """The WebP files that follow each other in media."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def from_media(media: list[bytes]) -> list[bytes]:
    """The payload of each row of media."""
    out: list[list[bytes]] = [[] for _ in media]
    held, owners, size = [], [], 0

    def flush():
        for owner, part in zip(owners, webp.decode_payloads(held), strict=True):
            out[owner].append(part)

    for k, m in enumerate(media):
        for f in split_files(m):
            held.append(f)
            owners.append(k)
            size += len(f)
            if size >= BATCH_BYTES:
                flush()
                held, owners, size = [], [], 0
    if held:
        flush()
    return [b"".join(x) for x in out]


def pixels(media: DataFrame) -> DataFrame:
    """doc_id, number (of the image in its document), height, width and argb: the pixel array of every image, four bytes each."""
    kind = media.schema["doc_id"].dataType.simpleString()
    bounded_batches(media.sparkSession)
    names = ["doc_id", "number", "height", "width", "argb"]

    def run(batches):
        for b in batches:
            for part, _, _ in pieces(b, "media", BATCH_BYTES // 4):
                for k, m in enumerate(part.column(1).to_pylist()):
                    files = split_files(m)
                    for a in range(0, len(files), 64):
                        images = webp.decode_many(files[a : a + 64])
                        one = part.column(0).slice(k, 1).take(pa.array([0] * len(images)))
                        yield pa.RecordBatch.from_arrays([one, pa.array(range(a, a + len(images)), pa.int32()), pa.array([x.shape[0] for x in images], pa.int32()), pa.array([x.shape[1] for x in images], pa.int32()), pa.array([x.tobytes() for x in images], pa.binary())], names=names)

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, number int, height int, width int, argb binary")


def feature(pixels: np.ndarray) -> str:
    """Rows, mean and spread of the samples, and an average hash over 8 x 8 cells."""
    grid = pixels.reshape(-1, webp.ROW)
    rows = len(grid)
    sums = np.add.reduceat(grid, np.arange(0, webp.ROW, webp.ROW // 8), 1, dtype=np.int64)
    mean, squares = sums.sum() / len(pixels), 0.0
    for a in range(0, len(pixels), BATCH_BYTES):
        part = pixels[a : a + BATCH_BYTES].astype(np.float64)
        squares += float(part @ part)
    spread = np.sqrt(max(0.0, squares / len(pixels) - mean**2))
    edges = np.arange(8) * rows // 8 if rows >= 8 else np.zeros(8, np.int64)
    cells = np.add.reduceat(sums, edges, 0) / np.diff(np.append(edges, rows))[:, None] if rows >= 8 else np.repeat(sums.sum(0)[None] / rows, 8, 0)
    return f"{webp.ROW}x{rows};mean={mean:.3f};sd={spread:.3f};ahash={np.packbits(cells > cells.mean()).tobytes().hex()}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every document; media is binary."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for part, data, at in pieces(b, limit=BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(to_media(data, at), pa.binary())], names=["doc_id", "n_bytes", "media"])
                trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def load(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (the samples read back) and the media's size and digest."""
    kind = media.schema["doc_id"].dataType.simpleString()
    bounded_batches(media.sparkSession)

    def run(batches):
        for b in batches:
            for part, _, _ in pieces(b, "media", BATCH_BYTES):
                stored = part.column(2).to_pylist()
                payload = pa.array(from_media(stored), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), payload, pa.array([len(m) for m in stored], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored])], names=["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload binary, media_bytes long, media_sha256 string")


def digests(media: DataFrame) -> DataFrame:
    """The contract's columns, from stored media."""
    kind = media.schema["doc_id"].dataType.simpleString()
    bounded_batches(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            for part, _, _ in pieces(b, "media", BATCH_BYTES):
                stored = part.column(2).to_pylist()
                got = from_media(stored)
                columns = [part.column(0), part.column(1), pa.array([len(p) for p in got], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in got])]
                columns += [pa.array([zlib.crc32(p[-32:]) for p in got], pa.int64()), pa.array([len(m) for m in stored], pa.int64())]
                columns += [pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array([feature(np.frombuffer(p, np.uint8)) for p in got])]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                trim()

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every document as an image in the shared folder and describe what is read back."""
    return digests(materialize(store(docs), "media"))
