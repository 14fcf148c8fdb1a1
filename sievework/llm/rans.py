"""Token ids as range asymmetric numeral systems (rANS) with static, shared frequency tables.

A file holds the ids of consecutive documents:

    magic, sizes | document index | frequency table | block index | blocks

One table of 16-bit frequencies serves all blocks of the file. A block codes some hundred thousand ids in
interleaved lanes: id k of a block belongs to lane k mod LANES, and all lanes share one stream of 16-bit words,
so that encoder and decoder work on whole vectors of lanes. Blocks are independent; the block index has each
block's place, its number of ids and the checksum of its bytes. Inside a block, checkpoints (the lanes' states
and the place in the stream) let a decoder start at any of them; the reader starts at all of them at once.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"SWRANS01"
SCALE_BITS, WORD_BITS = 16, 16
LANES, BLOCK_IDS, CHECKPOINT_STEPS = 2048, 1 << 18, 64
_FLOOR = np.uint64(1 << 16)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^16, at least 1 for each symbol that occurs."""
    total, m = int(counts.sum()), 1 << SCALE_BITS
    if not len(counts):
        return np.zeros(0, np.int64)
    used = counts > 0
    if used.sum() > m:
        raise ValueError("more symbols than the table has room for")
    out = np.where(used, np.maximum(1, counts.astype(np.int64) * m // max(total, 1)), 0)
    rest = m - int(out.sum())
    order = np.argsort(-out, kind="stable")
    if rest >= 0:
        out[order[0]] += rest
    for s in order:
        if rest >= 0:
            break
        less = min(-rest, int(out[s]) - 1)
        out[s] -= less
        rest += less
    return out


class Table:
    """Symbols in ascending order with their frequencies."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id in the table; ids must be in it."""
        if not len(ids) or self.symbols[-1] >= 1 << 20:
            return np.searchsorted(self.symbols, ids)
        dense = np.zeros(int(self.symbols[-1]) + 1, np.int32)
        dense[self.symbols] = np.arange(len(self.symbols))
        return dense[ids]

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        if len(ids) and ids.max() < 1 << 20:
            counts = np.bincount(ids)
            symbols = np.flatnonzero(counts)
            counts = counts[symbols]
        else:
            symbols, counts = np.unique(ids, return_counts=True)
        return cls(symbols, frequencies(counts))

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """Checkpoints and words of one block; the first checkpoint has the states to start from."""
    where = table.places(ids)
    freq, start = table.freq[where], table.start[where]
    steps = -(-len(ids) // lanes)
    x = np.full(lanes, _FLOOR, np.uint64)
    words, marks, sent = [], [], 0
    bits = np.uint64(WORD_BITS)
    for s in range(steps - 1, -1, -1):
        f, c = freq[s * lanes : (s + 1) * lanes], start[s * lanes : (s + 1) * lanes]
        y = x[: len(f)]
        full = y >= f << bits
        if full.any():
            out = (y[full] & np.uint64(0xFFFF)).astype("<u2")
            words.append(out)
            sent += len(out)
            y[full] >>= bits
        q = y // f
        y[:] = (q << np.uint64(SCALE_BITS)) + (y - q * f) + c
        if s % CHECKPOINT_STEPS == 0:
            marks.append((s, sent, x.astype("<u4").tobytes()))
    head = np.array([lanes, len(marks), sent], "<u4").tobytes()
    places = b"".join(np.array([s, sent - n], "<u4").tobytes() + states for s, n, states in reversed(marks))
    return head + places + b"".join(w.tobytes() for w in reversed(words))


def decode_blocks(blocks: list[bytes], sizes: list[int], table: Table, slots: np.ndarray | None = None) -> np.ndarray:
    """The ids of blocks of so many ids each: all of their checkpoints are decoded side by side."""
    slots = table.slots() if slots is None else slots
    states, firsts, places, words, out_at, room = [], [], [], [], [], []
    sent = filled = lanes = 0
    for block, n in zip(blocks, sizes, strict=True):
        lanes, n_marks, n_words = np.frombuffer(block, "<u4", 3).tolist()
        marks = np.frombuffer(block, "<u4", n_marks * (2 + lanes), 12).reshape(n_marks, 2 + lanes)
        states.append(marks[:, 2:])
        firsts.append(marks[:, 0].astype(np.int64))
        places.append(marks[:, 1].astype(np.int64) + sent)
        words.append(np.frombuffer(block, "<u2", n_words, 12 + 4 * n_marks * (2 + lanes)))
        out_at.append(filled + firsts[-1] * lanes)
        # A checkpoint is followed up to the next one.
        room.append(np.diff(np.append(firsts[-1] * lanes, n)))
        sent, filled = sent + n_words, filled + n
    out = np.zeros(filled, np.uint32)
    if not filled:
        return out
    x, place, at, left = np.concatenate(states).astype(np.uint64), np.concatenate(places), np.concatenate(out_at), np.concatenate(room)
    stream = np.concatenate([*words, np.zeros(1, np.uint16)]).astype(np.uint64)
    low, lane = np.uint64((1 << SCALE_BITS) - 1), np.arange(lanes)
    while len(left):
        slot = x & low
        symbol = slots[slot]
        live = lane < left[:, None]
        out[(at[:, None] + lane)[live]] = symbol[live]
        x = table.freq[symbol] * (x >> np.uint64(SCALE_BITS)) + slot - table.start[symbol]
        need = (x < _FLOOR) & live
        rank = np.cumsum(need, 1)
        index = np.minimum((place[:, None] + rank - 1)[need], len(stream) - 1)
        x[need] = x[need] << np.uint64(WORD_BITS) | stream[index]
        place, at, left = place + rank[:, -1], at + lanes, left - lanes
        more = left > 0
        x, place, at, left = x[more], place[more], at[more], left[more]
    return table.symbols[out]


def write_file(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """A file of documents: their ids (and whether they have one), token counts, and all their tokens in order."""
    table = Table.of(ids)
    blocks = [encode_block(ids[k : k + block_ids], table) for k in range(0, len(ids), block_ids)]
    head = MAGIC + np.array([len(doc_ids), len(table.symbols), len(blocks), block_ids, len(ids)], "<u8").tobytes()
    index = doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + counts.astype("<u8").tobytes()
    shared = table.symbols.astype("<u4").tobytes() + (table.freq - np.uint64(1)).astype("<u2").tobytes()
    ends = np.cumsum([len(b) for b in blocks]).astype("<u8")
    places = ends.tobytes() + np.array([zlib.crc32(b) for b in blocks], "<u4").tobytes()
    body = index + shared + places
    return head + np.array([zlib.crc32(head + body)], "<u4").tobytes() + body + b"".join(blocks)


class File:
    """Reads a file: its documents, and any of its blocks."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of token ids")
        n, symbols, blocks, self.block_ids, self.n_ids = np.frombuffer(data, "<u8", 5, 8).tolist()
        at = 8 + 40 + 4

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known, self.counts = take("<i8", n), take("u1", n).astype(bool), take("<u8", n).astype(np.int64)
        self.table = Table(take("<u4", symbols), take("<u2", symbols).astype(np.uint64) + np.uint64(1))
        self.ends, self.sums = take("<u8", blocks).astype(np.int64), take("<u4", blocks)
        if zlib.crc32(data[:48] + data[52:at]) != int(np.frombuffer(data, "<u4", 1, 48)[0]):
            raise ValueError("the header's checksum is wrong")
        self.data, self.base = data, at
        self._slots = self.table.slots() if symbols else None

    def blocks(self, first: int, end: int) -> np.ndarray:
        """The ids of some blocks."""
        at = np.concatenate([[0], self.ends]) + self.base
        found = [self.data[at[k] : at[k + 1]] for k in range(first, end)]
        for k, block in enumerate(found, first):
            if zlib.crc32(block) != int(self.sums[k]):
                raise ValueError(f"block {k}'s checksum is wrong")
        return decode_blocks(found, [min(self.block_ids, self.n_ids - k * self.block_ids) for k in range(first, end)], self.table, self._slots)

    def ids(self) -> np.ndarray:
        return self.blocks(0, len(self.ends))
