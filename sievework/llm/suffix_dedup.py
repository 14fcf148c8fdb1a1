"""Removal of repeated byte strings: candidates by minimizers, equality by bucket-pointer refinement.

A window of 100 bytes is known by its minimizer, the 32-byte string in it with the smallest hash (the first,
if several); equal windows have equal minimizers at equal places. Neighbouring windows with one minimizer form
an entry, with the string they span as its context. Blocks exchange entries, once each:

- an entry whose context occurs earlier is repeated as a whole;
- the first entry of each context, where a minimizer has several contexts, sends its span to its minimizer's
  bucket. There the spans' suffixes are sorted: first into buckets of 8-byte strings, then each bucket of two
  or more by the bucket pointers of later offsets, which doubles the depth; pointers refined in one round are
  the keys of the next. At depth 100 a bucket holds the occurrences of one window, of which the first stays;
- a minimizer with very many contexts would gather them all in one bucket. Its windows are hashed one by one
  and exchanged by their own hashes, which no minimizer concentrates; they are compared by 126 bits.

Windows never cross documents and are judged on the input. Defined results: null text is empty; texts shorter
than a window stay whole; null doc_id comes first; of rows that repeat a doc_id one comes first; an empty table
gives an empty table. Minimizers have 64-bit hashes, which only bring entries together. Contexts have 62 bits of
two polynomials modulo 2^31 - 1 at places that are drawn for each run, so that no text can be made to meet
another's hash; windows of several contexts are compared by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .blocks import ANSWER_SCHEMA, MESSAGE_SCHEMA, Block, answered, messages, n_tasks, pack, per_block, slices, text_bytes, with_answers
from .common import _ODD, buckets_for, fresh_key, materialize, mix, ragged
from .substring_dedup import distinct_pairs, entries, later_entries

WINDOW, GRAM, FIRST_DEPTH = 100, 32, 8
#: Contexts of a minimizer from which on its windows are exchanged one by one.
HOT = 4096
#: Larger blocks than others', as entries are few for their text.
SUFFIX_BLOCK_BYTES = 2 << 20
#: Bytes of spans in a refinement task.
REFINED_BYTES = 1 << 20
ENTRY = np.dtype([("doc", "<i8"), ("context", "<u8")])
SPAN = np.dtype([("doc_id", "<i8"), ("place", "<i8"), ("n", "<i4")])
LATER, SORTED, ONE_BY_ONE = 1, 2, 4


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PRIME = np.uint64((1 << 31) - 1)
_tables: dict[tuple[int, int], np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """Powers modulo 2^64."""
    table = _tables.get((int(base), 64))
    if table is None or len(table) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        table = _tables[int(base), 64] = np.multiply.accumulate(steps)
    return table[:n]


def _residues(base: int, n: int) -> np.ndarray:
    """Powers modulo the prime."""
    table = _tables.get((base, 31))
    if table is None or len(table) < n:
        table, step = np.ones(1, np.uint64), base
        while len(table) < max(n, 1 << 16):
            table, step = np.concatenate([table, table * np.uint64(step) % _PRIME]), step * step % int(_PRIME)
        # A run uses four tables; those of runs before it are let go.
        for old in [k for k in _tables if k[1] == 31][:-8]:
            del _tables[old]
        _tables[base, 31] = table
    return table[:n]


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial modulo 2^64, for minimizers: they choose, and decide nothing."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


class Exact:
    """62-bit hashes of byte spans: two polynomials over a prime field, at places from the key."""

    def __init__(self, data: np.ndarray, key: tuple[int, ...]):
        self.lanes = []
        for k in key[:2]:
            base = 2 + k % (int(_PRIME) - 3)
            terms = (data.astype(np.uint64) + np.uint64(1)) * _residues(base, len(data))
            terms = (terms & _PRIME) + (terms >> np.uint64(31))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.lanes.append((sums, _residues(pow(base, -1, int(_PRIME)), len(data) + 1)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = ((sums[ends] - sums[starts]) % _PRIME * inverse[starts] % _PRIME for sums, inverse in self.lanes)
        return one << np.uint64(32) | two


def find_entries(data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> bytes:
    """For each entry its number of windows and its minimizer's offset, a byte each."""
    n = len(data)
    if n < window:
        return b""
    sums, inverse = _sums(data), _power(_INVERSE, n + 1)
    m = n - gram + 1
    value = mix((sums[gram:] - sums[:m]) * inverse[:m])
    offset, width, want = np.zeros(m, np.uint8), 1, window - gram + 1

    def widen(value, offset, k):
        left, right = value[:-k], value[k:]
        return np.minimum(left, right), np.where(right < left, offset[k:] + np.uint8(k), offset[:-k])

    while width < want:
        k = min(width, want - width)
        value, offset = widen(value, offset, k)
        width += k
    ends = np.repeat(at[1:], np.diff(at))[: len(value)]
    places = np.flatnonzero(np.arange(len(value)) + window <= ends)
    if not len(places):
        return b""
    anchors = places + offset[places]
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    counts = np.diff(np.append(first, len(places)))
    return np.stack([counts.astype(np.uint8), offset[places[first]]]).tobytes()


class Entries:
    """The entries of a block: first window, number of windows, minimizer hash and context hash."""

    def __init__(self, block: Block, key: tuple[int, ...], window: int = WINDOW, gram: int = GRAM):
        marks = block.marks.reshape(2, -1).astype(np.int64)
        sizes = np.diff(block.at)
        places = ragged(block.at[:-1], np.maximum(0, sizes - window + 1))
        self.n = marks[0]
        self.first = places[np.cumsum(self.n) - self.n] if len(self.n) else np.zeros(0, np.int64)
        self.span = self.n + window - 1
        self.doc = np.searchsorted(block.at, self.first, "right") - 1
        self.sums, self.inverse = _sums(block.data), _power(_INVERSE, len(block.data) + 1)
        self.exact = Exact(block.data, key)
        anchor = self.first + marks[1]
        # Minimizers have small hashes; hashed again they spread over all buckets.
        self.hash = mix(self._plain(anchor, gram) ^ _ODD)
        self.context = mix(self.exact.hashes(self.first, self.first + self.span) + (self.span * 256 + marks[1]).astype(np.uint64) * _ODD)
        #: The first entry of each pair of minimizer and context, in order of the pair.
        self.distinct, _ = distinct_pairs(self.hash, self.context)

    def _plain(self, places: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[places + size] - self.sums[places]) * self.inverse[places])

    def windows(self, which: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, in order, and both hashes of the windows of some entries."""
        places = np.sort(ragged(self.first[which], self.n[which]))
        return places, self._plain(places, window), self.exact.hashes(places, places + window)


def _judge(hashes, extra, block):
    """LATER, SORTED or ONE_BY_ONE for each entry sent; 0 where nothing repeats."""
    context = extra["context"]
    order = np.lexsort((block, extra["doc"], context, hashes))
    h, c = hashes[order], context[order]
    new_hash = np.ones(len(h), bool)
    new_hash[1:] = h[1:] != h[:-1]
    new = new_hash.copy()
    new[1:] |= c[1:] != c[:-1]
    group = np.cumsum(new_hash) - 1
    contexts = np.bincount(group, weights=new)[group]
    out = np.zeros(len(h), np.uint8)
    out[order] = np.where(~new, LATER, np.where(contexts > HOT, ONE_BY_ONE, np.where(contexts > 1, SORTED, 0)))
    return out


def refine(text: np.ndarray, ends: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Bucket pointers of all suffixes at `depth`: equal where the next `depth` bytes are; -1 where a span ends before.

    ends[i] is the end of the span that holds position i."""
    n = len(text)
    room = ends - np.arange(n)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(FIRST_DEPTH, np.uint8)])
    for k in range(FIRST_DEPTH):
        key = key << np.uint64(8) | padded[k : n + k].astype(np.uint64)
    pointer = np.full(n, -1, np.int64)
    active = np.flatnonzero(room >= FIRST_DEPTH)
    order = np.argsort(key[active], kind="stable")
    active = active[order]
    k = key[active]
    last = np.append(np.flatnonzero(k[1:] != k[:-1]), len(k) - 1) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(last, prepend=-1)
    pointer[active] = np.repeat(last, sizes)
    here = FIRST_DEPTH
    while here < depth:
        step = min(here, depth - here)
        fits = room[active] >= here + step
        active = active[fits]
        # Active suffixes are in order of their pointers; buckets of one need no more keys.
        p = pointer[active]
        alone = np.ones(len(p), bool)
        alone[1:] &= p[1:] != p[:-1]
        alone[:-1] &= p[1:] != p[:-1]
        many = active[~alone]
        old = pointer[many]
        order = np.lexsort((pointer[many + step], old)) if n >= 1 << 31 else np.argsort(old << 32 | pointer[many + step], kind="stable")
        many, old = many[order], old[order]
        by = pointer[many + step]
        refined = pointer.copy()
        if len(many):
            edge = np.append((old[1:] != old[:-1]) | (by[1:] != by[:-1]), True)
            bucket = np.append(old[1:] != old[:-1], True)
            last = np.flatnonzero(edge)
            bucket_last = np.flatnonzero(bucket)
            end_of = np.repeat(bucket_last, np.diff(bucket_last, prepend=-1))
            own_end = np.repeat(last, np.diff(last, prepend=-1))
            refined[many] = old - (end_of - own_end)
        pointer = refined
        active = many
        here += step
    pointer[room < depth] = -1
    return pointer


def later_windows(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """For each window of a bucket's spans, 1 where an equal one comes earlier."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block_id"])
    spans = [np.frombuffer(r["extra"], SPAN) for r in rows]
    sizes = [len(s) for s in spans]
    meta = np.concatenate(spans)
    block = np.repeat(np.arange(len(rows)), sizes)
    text = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    n = meta["n"].astype(np.int64)
    length = n + window - 1
    ends = np.cumsum(length)
    pointer = refine(text, np.repeat(ends, length), window)
    starts = ragged(ends - length, n)
    entry = np.repeat(np.arange(len(n)), n)
    place = meta["place"][entry] + starts - (ends - length)[entry]
    order = np.lexsort((place, block[entry], meta["doc_id"][entry], pointer[starts]))
    p = pointer[starts][order]
    out = np.zeros(len(starts), np.uint8)
    out[order[1:]] = p[1:] == p[:-1]
    cuts = np.cumsum([s["n"].sum() for s in spans])
    return pa.table({"block_id": pa.array([r["block_id"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "answer": pa.array([zstandard.ZstdCompressor(1).compress(x.tobytes()) for x in np.split(out, cuts[:-1])], pa.binary())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep`, n_bytes, n_removed, spans (removed runs of bytes) and kept (the other bytes)."""
    if not 16 <= gram < window <= gram + 200:
        raise ValueError("a window is longer than a gram, by 200 bytes at most")
    blocks = pack(docs, keep, text, mark=lambda data, at: find_entries(data, at, window, gram), block_bytes=SUFFIX_BLOCK_BYTES)
    key = fresh_key()
    total = text_bytes(blocks)
    entry_buckets, hot_buckets, tasks = buckets_for(int(0.8 * total)), buckets_for(int(0.8 * total)), n_tasks(total)
    span_buckets = -(-max(1, total) // (4 * REFINED_BYTES)) + 7

    def send_entries(block: Block):
        e = Entries(block, key, window, gram)
        d = e.distinct
        extra = np.zeros(len(d), ENTRY)
        extra["doc"], extra["context"] = block.ids[e.doc[d]], e.context[d]
        return messages(block.id, entry_buckets, e.hash[d], extra)

    def send_windows(block: Block, codes: np.ndarray):
        e = Entries(block, key, window, gram)
        chosen = e.distinct[codes == SORTED]
        at = slices(e.hash[chosen], span_buckets)
        rows = {name: [] for name in KINDS.names}
        for k in np.flatnonzero(np.diff(at)).tolist():
            c = chosen[at[k] : at[k + 1]]
            meta = np.zeros(len(c), SPAN)
            meta["doc_id"], meta["place"], meta["n"] = block.ids[e.doc[c]], e.first[c], e.n[c]
            for name, value in zip(rows, (k, block.id, b"", meta.tobytes(), block.data[ragged(e.first[c], e.span[c])].tobytes(), SORTED), strict=True):
                rows[name].append(value)
        spans = pa.table(rows, schema=KINDS)
        places, hashes, second = e.windows(e.distinct[codes == ONE_BY_ONE], window)
        first, _ = distinct_pairs(hashes, second)
        docs_of = block.ids[np.searchsorted(block.at, places[first], "right") - 1]
        single = pa.Table.from_batches([messages(block.id, hot_buckets, hashes[first], entries(docs_of, second[first]))])
        for name, value in (("bytes", pa.array([b""] * single.num_rows, pa.binary())), ("kind", pa.array([ONE_BY_ONE] * single.num_rows, pa.int32()))):
            single = single.append_column(name, value)
        return pa.concat_tables([spans, single.cast(KINDS)])

    added = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL(added)])
    arrow = to_arrow_schema(schema)

    def cut(block: Block, codes: np.ndarray, by_order: np.ndarray, by_hash: np.ndarray):
        e = Entries(block, key, window, gram)
        n = len(block.data)
        code = np.full(len(e.n), LATER, np.uint8)
        code[e.distinct] = codes
        whole = np.flatnonzero(code == LATER)
        marked = [ragged(e.first[whole], e.n[whole])]
        chosen = e.distinct[codes == SORTED]
        # Spans were sent in order of their minimizers, so the answers join in that order.
        marked.append(ragged(e.first[chosen], e.n[chosen])[by_order > 0])
        places, hashes, second = e.windows(e.distinct[codes == ONE_BY_ONE], window)
        if len(places):
            first, _ = distinct_pairs(hashes, second)
            later = np.ones(len(places), bool)
            later[first] = by_hash > 0
            marked.append(places[later])
        marked = np.concatenate(marked)
        edge = np.zeros(n + 1, np.int32)
        edge[marked] += 1
        np.add.at(edge, marked + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        starts_run = gone.copy()
        starts_run[1:] &= ~gone[:-1]
        inner = block.at[(block.at > 0) & (block.at < n)]
        starts_run[inner] = gone[inner]
        ends_run = gone.copy()
        ends_run[:-1] &= ~gone[1:]
        ends_run[inner - 1] = gone[inner - 1]
        a, b = np.flatnonzero(starts_run), np.flatnonzero(ends_run) + 1
        at = np.searchsorted(a, block.at)
        base = block.at[np.searchsorted(block.at, a, "right") - 1]
        spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], ["start", "end"]))
        before = np.concatenate([[0], np.cumsum(~gone)])
        kept_at = before[block.at]
        kept = block.data[~gone].tobytes()
        texts = [kept[x:y] for x, y in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
        sizes = np.diff(block.at)
        return block.beside(arrow, sizes, sizes - np.diff(kept_at), spans, texts)

    codes = answered(per_block(blocks, send_entries, MESSAGE_SCHEMA), _judge, "entries", entry_buckets, ENTRY)
    sent = materialize(with_answers(blocks, [codes], send_windows, "bucket int, block_id long, hashes binary, extra binary, bytes binary, kind int", tasks), "spans")
    spans = sent.filter(F.col("kind") == SORTED).repartition(n_tasks(total), "bucket")
    by_order = materialize(spans.groupBy("bucket").applyInArrow(lambda t: later_windows(t, window), ANSWER_SCHEMA), "sorted")
    by_hash = answered(sent.filter(F.col("kind") == ONE_BY_ONE).select("bucket", "block_id", "hashes", "extra"), later_entries, "windows", hot_buckets)
    return with_answers(blocks, [codes, by_order, by_hash], cut, schema, tasks)


KINDS = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("hashes", pa.binary()), ("extra", pa.binary()), ("bytes", pa.binary()), ("kind", pa.int32())])


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
