"""Removal of repeated word windows, found through difference-cover anchors.

Word p of a document is a cover position if p mod 13 is in {0, 1, 3, 9}. These residues have every difference
modulo 13, so for any two places some offset of 0 to 12 puts both on cover positions: two equal windows of W
words share an aligned anchor of W - 12 words. Only anchors at cover positions are hashed and exchanged; the
windows around anchors that occur twice or more are then extended to all W words and compared.

Three passes over the blocks: anchors (one hash for each in a block), windows that hold a repeated anchor (one
hash and the block's first document for each), and the cut. An occurrence stays only if it is the first by
(doc_id, start); all others mark their words, and marked words go. Windows are judged on the input.

Defined results: null and empty texts have no words and keep nothing; texts shorter than a window stay whole;
null doc_id comes first; rows that repeat a doc_id are separate documents, of which one comes first; an empty
table gives an empty table. Words are told apart by their bytes (longer ones by BLAKE2), windows by 128 bits
from them under a key that is drawn for each run; an anchor's 64 bits only name candidates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .blocks import DOC, MESSAGE_SCHEMA, Block, answered, messages, n_tasks, pack, per_block, text_bytes, with_answers
from .common import buckets_for, fresh_key, join_hashes, ragged, span_hashes, word_spans

PERIOD = 13
COVER = np.isin(np.arange(PERIOD), [0, 1, 3, 9])


def sequence_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hash of the `length` words from every place on; places too near the end are left out."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, rest = None, 0, words, length
    while rest:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else join_hashes(out, part, lane)
            done += len(words) - len(power) + 1
        rest >>= 1
        if rest:
            width = len(words) - len(power) + 1
            power = join_hashes(power[:-width], power[width:], lane) if len(power) > width else power[:0]
    return out


class Words:
    """Words of a block, with the places where windows may start."""

    def __init__(self, block: Block, window: int, key: tuple[int, ...]):
        self.starts, self.ends, self.at = word_spans(block.data, block.at)
        self.hashes, self.second = span_hashes(block.data, self.starts, self.ends, key)
        self.doc = np.repeat(np.arange(len(block.ids)), np.diff(self.at))
        self.place = np.arange(len(self.starts)) - self.at[self.doc] if len(self.doc) else self.doc
        self.left = self.at[self.doc + 1] - np.arange(len(self.starts)) if len(self.doc) else self.doc
        self.window = window

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions and the hashes of their anchors."""
        length = self.window - PERIOD + 1
        places = np.flatnonzero(COVER[self.place % PERIOD] & (self.left >= length))
        return places, sequence_hashes(self.hashes, length)[places] if len(places) else np.zeros(0, np.uint64)

    def candidates(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both hashes of the windows that hold one of the anchors."""
        edge = np.zeros(len(self.starts) + 1, np.int32)
        first = np.maximum(places - (PERIOD - 1), self.at[self.doc[places]] if len(places) else 0)
        np.add.at(edge, first, 1)
        np.add.at(edge, places + 1, -1)
        starts = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= self.window))
        if not len(starts):
            return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return starts, sequence_hashes(self.hashes, self.window)[starts], sequence_hashes(self.second, self.window, 1)[starts]


def unique(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the first place, the inverse and the count of each."""
    return np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)


def distinct_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct pair, in order of the pairs, and each place's number in that order."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    inverse = np.zeros(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _shared(hashes, extra, block):
    """1 for hashes that more than one block sent."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    out = np.zeros(len(h), np.uint8)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def later_entries(hashes, extra, block):
    """1 for entries whose hashes another entry precedes, by document and then block."""
    order = np.lexsort((block, extra["doc"], extra["check"], hashes))
    h, c = hashes[order], extra["check"][order]
    out = np.zeros(len(h), np.uint8)
    out[order[1:]] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    return out


def entries(docs: np.ndarray, checks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(docs), DOC)
    out["doc"], out["check"] = docs, checks
    return out


def _repeated(words: Words, shared: np.ndarray) -> np.ndarray:
    """Cover positions whose anchor occurs more than once, here or elsewhere."""
    places, hashes = words.anchors()
    if not len(places):
        return places
    _, _, inverse, count = unique(hashes)
    return places[((count > 1) | (shared > 0))[inverse]]


def remove_repeats(docs: DataFrame, window: int = 20, keep: tuple[str, ...] = ("doc_id",), text: str = "text", whole: bool = False) -> DataFrame:
    """The columns `keep`, n_words, n_removed, and kept: the words that stay, joined by one space.

    With `whole`, a text that loses no word is kept as it is."""
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    blocks = pack(docs, keep, text)
    key = fresh_key()
    total = text_bytes(blocks)
    first_buckets, second_buckets, tasks = buckets_for(int(0.4 * total)), buckets_for(int(1.2 * total)), n_tasks(total)

    def send_anchors(block: Block):
        _, hashes = Words(block, window, key).anchors()
        return messages(block.id, first_buckets, np.unique(hashes))

    def send_windows(block: Block, shared: np.ndarray):
        words = Words(block, window, key)
        starts, hashes, second = words.candidates(_repeated(words, shared))
        first, _ = distinct_pairs(hashes, second)
        return messages(block.id, second_buckets, hashes[first], entries(block.ids[words.doc[starts[first]]], second[first]))

    schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL("n_words long, n_removed long, kept string")])
    arrow = to_arrow_schema(schema)

    def cut(block: Block, shared: np.ndarray, later: np.ndarray):
        words = Words(block, window, key)
        starts, hashes, second = words.candidates(_repeated(words, shared))
        n = len(words.starts)
        gone = np.zeros(n, bool)
        if len(starts):
            first, _ = distinct_pairs(hashes, second)
            marked = np.ones(len(starts), bool)
            marked[first] = later > 0
            edge = np.zeros(n + 1, np.int32)
            edge[starts[marked]] += 1
            edge[starts[marked] + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
        stay = np.flatnonzero(~gone)
        sizes = words.ends[stay] - words.starts[stay] + 1
        kept = block.data[np.minimum(ragged(words.starts[stay], sizes), max(0, len(block.data) - 1))].copy() if len(stay) else np.zeros(0, np.uint8)
        ends = np.cumsum(sizes)
        kept[ends - 1] = 32
        bounds = np.concatenate([[0], ends])[np.searchsorted(stay, words.at)]
        joined = kept.tobytes()
        texts = [joined[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        removed = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), words.at[:-1]) * (np.diff(words.at) > 0) if len(block.ids) else np.zeros(0, np.int64)
        if whole:
            for k in np.flatnonzero(removed == 0).tolist():
                texts[k] = block.data[block.at[k] : block.at[k + 1]].tobytes().decode()
        return block.beside(arrow, np.diff(words.at), removed, texts)

    shared = answered(per_block(blocks, send_anchors, MESSAGE_SCHEMA), _shared, "anchors", first_buckets)
    later = answered(with_answers(blocks, [shared], send_windows, MESSAGE_SCHEMA, tasks), later_entries, "windows", second_buckets)
    return with_answers(blocks, [shared, later], cut, schema, tasks)


def digests(docs: DataFrame, window: int = 20) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
