"""Token ids of many texts at once with the tokenizers library, each distinct piece tokenized once.

The pre-tokenizer drops white space and keeps runs of letters and runs of signs apart. So texts are cut into
segments at white space, and between a letter (ASCII or Latin-1, two bytes from C3) and an ASCII sign other
than an apostrophe; no piece of the tokenizer crosses such a cut. Letters of these alphabets are put in lower
case, as the normalizer does, and segments are looked up in a table of bounded size, by two numbers that hold their
bytes (for longer ones a digest). Segments of letters only, or of signs only, are one piece each, so they are
tokenized joined by spaces, by the file's model without the steps that leave them as they are; each ends with its
one id that ends a word. All other segments (digits, apostrophes, other alphabets) go through the whole tokenizer
one by one. So do the file's added tokens: the library looks for them in the raw text before all else, and each is a
segment of its own here.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import SPACE, fresh_key, mix, ragged, span_numbers
from .substring_dedup import distinct_pairs

#: Segments that a table holds; with more it starts anew.
REMEMBERED = 1_000_000
_OTHER, _LETTER, _SIGN = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = _SIGN


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with ASCII and Latin-1 letters in lower case, and the kind of every byte."""
    kind, out = _KIND[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    if len(lead):
        after = data[lead + 1]
        letter = (after != 0x97) & (after != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        upper = lead[letter & (after <= 0x9E)] + 1
        out[upper] += 32
    return out, kind


def segments(data: np.ndarray, kind: np.ndarray, at: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all segments of the rows, and the n+1 segment offsets of the rows.

    whole has pairs of start and end of spans that are segments whatever they hold."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = (inside[1:] != inside[:-1]) | (kind[1:] ^ kind[:-1] == _LETTER ^ _SIGN)
    for a, b in whole.tolist():
        cut[a:b] = False
    cut[whole.reshape(-1)] = True
    cut[at] = True
    places = np.flatnonzero(cut)
    starts, ends = places[:-1], places[1:]
    full = inside[starts]
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, at)


class WordCache:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        added = self.whole.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip or not t.content or SPACE[np.frombuffer(t.content.encode(), np.uint8)].any() for t in added):
            raise ValueError("an added token is not looked for in the raw text as it stands")
        longest_first = sorted((t.content.encode() for t in added), key=lambda x: (-len(x), x))
        self.added = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        self.key = np.uint64(fresh_key()[0])
        self.forget()

    def forget(self) -> None:
        size = 1 << (2 * REMEMBERED).bit_length()
        self.mask = np.uint64(size - 1)
        self.low, self.high, self.values = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix(low ^ mix(high * self.key + self.key)) & self.mask

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each segment among the known ones, or -1."""
        out = np.full(len(low), -1, np.int32)
        todo, place = np.arange(len(low)), self._places(low, high)
        while len(todo):
            value = self.values[place]
            hit = (value >= 0) & (self.low[place] == low[todo]) & (self.high[place] == high[todo])
            out[todo[hit]] = value[hit]
            more = ~hit & (value >= 0)
            todo, place = todo[more], (place[more] + np.uint64(1)) & self.mask
        return out

    def _enter(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> None:
        """Enter segments that are not known, each once."""
        place, todo = self._places(low, high), np.arange(len(low))
        while len(todo):
            free = self.values[place] < 0
            # Of several that want one place, the last written stays; the others go on.
            self.values[place[free]] = values[todo[free]]
            mine = self.values[place] == values[todo]
            self.low[place[mine]], self.high[place[mine]] = low[todo[mine]], high[todo[mine]]
            todo, place = todo[~mine], (place[~mine] + np.uint64(1)) & self.mask

    def _learn(self, low: np.ndarray, high: np.ndarray, texts: list[str], plain: np.ndarray) -> None:
        known, ids, sizes = len(self.start), [self.ids], np.zeros(len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        groups = [" ".join([texts[i] for i in order[a : min(a + 1000, n)].tolist()]) for a in range(0, n, 1000)]
        joined = [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(groups, add_special_tokens=False)] if groups else []
        if joined:
            flat = np.concatenate(joined)
            ends = np.flatnonzero(self.ends_word[flat])
            if len(ends) != n:
                raise ValueError("the file's model does not end each piece with one word end")
            sizes[:n] = np.diff(ends, prepend=-1)
            ids.append(flat)
        for k, e in enumerate(self.whole.encode_batch_fast([texts[i] for i in order[n:].tolist()], add_special_tokens=False), n):
            sizes[k] = len(e.ids)
            ids.append(np.array(e.ids, np.uint32))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate(ids)
        self._enter(low[order], high[order], np.arange(known, len(self.start), dtype=np.int32))

    def _added(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Start and end of the added tokens in the rows, from the left, none across rows."""
        out = []
        if self.added is not None:
            raw = data.tobytes()
            if self.added.search(raw):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    out += [m.span() for m in self.added.finditer(raw, a, b)]
        return np.array(out, np.int64).reshape(-1, 2)

    def encode(self, data: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of text, each with the end id, and their numbers."""
        if len(self.start) > REMEMBERED:
            self.forget()
        low, kind = lowered(data)
        whole = self._added(data, at)
        for a, b in whole.tolist():
            low[a:b], kind[a:b] = data[a:b], _OTHER
        starts, ends, row_at = segments(low, kind, at, whole)
        one, two = span_numbers(low, starts, ends)
        found = self._find(one, two)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            first = missing[distinct_pairs(one[missing], two[missing])[0]]
            a, b = starts[first], ends[first]
            odd = np.concatenate([[0], np.cumsum(kind == _OTHER)])
            raw = low.tobytes()
            texts = [raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            self._learn(one[first], two[first], texts, odd[b] == odd[a])
            found = self._find(one, two)
        sizes = self.size[found]
        flat = self.ids[ragged(self.start[found], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[row_at[1:]]
        counts = np.diff(upto, prepend=0) + 1
        out = np.full(len(flat) + len(counts), end_id, np.uint32)
        stay = np.ones(len(out), bool)
        stay[np.cumsum(counts) - 1] = False
        out[stay] = flat
        return out, counts
