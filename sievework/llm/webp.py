"""Lossless WebP (VP8L): a decoder for the whole format, and a writer for byte payloads.

`decode_many` reads any lossless images: prefix codes, back-references, colour cache, meta prefix codes, and the
predictor, cross-colour, subtract-green and palette transforms; each becomes an array of ARGB bytes. Images with
one group of codes and no colour cache, whose red, blue and alpha are constant, are followed side by side, a token
of each in a step; all others, and the last few of the former, pixel by pixel.

`encode_payloads` stores byte strings as grey images of at most ROWS rows: literals and back-references to what came
before in the image, under one complete prefix code that suits text, with the subtract-green transform; or, where
that is smaller, a palette whose indexes share pixels. Predictor, cross-colour and colour cache never make grey text
smaller (a literal is one code of a few bits), so the writer leaves them out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import ragged

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE, MAX_SIDE, MAX_CODE = 0x2F, 16384, 15
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
#: Near pixels by distance, then by rows above, then from right to left sides: codes 1 to 120.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class Bits:
    """Reads bits from the least significant end on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def peek_many(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + n // 8 + 2], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("truncated image")
        return out


def canonical(lengths) -> np.ndarray:
    """Codes of a canonical prefix code, their first bit in the lowest place."""
    lengths = np.asarray(lengths)
    codes, code = np.zeros(len(lengths), np.int64), 0
    for n in range(1, MAX_CODE + 1):
        code <<= 1
        for s in np.flatnonzero(lengths == n):
            codes[s] = int(f"{code:0{n}b}"[::-1], 2)
            code += 1
    return codes


class PrefixCode:
    """A prefix code from its lengths; one symbol alone takes no bits."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            used = np.array([0])
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            return
        self.width = int(lengths.max())
        if (1 << (self.width - lengths[used])).sum() != 1 << self.width:
            raise ValueError("incomplete prefix code")
        codes = canonical(lengths)
        self.symbol, self.length = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.uint8)
        for s in used:
            n = int(lengths[s])
            self.symbol[codes[s] :: 1 << n] = s
            self.length[codes[s] :: 1 << n] = n
        self.pairs = list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.pairs[bits.peek(self.width)]
        bits.at += n
        return symbol


def read_prefix_code(bits: Bits, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    of_lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = PrefixCode(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left > 0:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            value, n = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3) if s == 17 else 11 + bits.read(7))
            if at + n > size:
                raise ValueError("code lengths overflow")
            lengths[at : at + n] = [value] * n
            at += n
    return PrefixCode(lengths)


def _amount(bits: Bits, code: int) -> int:
    """Length or distance of a prefix symbol with its extra bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


@dataclass
class Codes:
    """What comes before the pixels of an entropy-coded image."""

    cache_bits: int
    shift: int
    columns: int
    groups_at: list[int] | None
    groups: list[list[PrefixCode]]

    def side_by_side(self) -> bool:
        return not self.cache_bits and len(self.groups) == 1 and all(c.only is not None for c in self.groups[0][1:4]) and self.groups[0][0].only is None


#: Groups of prefix codes that were read before, by their number of bits and those bits: files of one writer share them.
_seen: dict[tuple[int, int, int], list[PrefixCode]] = {}
_REMEMBERED = 64


def _group(bits: Bits, cache_bits: int) -> list[PrefixCode]:
    first = bits.at
    for (n, value, cache), group in _seen.items():
        if cache == cache_bits and bits.peek_many(n) == value:
            bits.at += n
            return group
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    group = [read_prefix_code(bits, n) for n in sizes]
    n, bits.at = bits.at - first, first
    if len(_seen) >= _REMEMBERED:
        _seen.pop(next(iter(_seen)))
    _seen[n, bits.peek_many(n), cache_bits] = group
    bits.at += n
    return group


def _codes(bits: Bits, width: int, height: int, top: bool) -> Codes:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    shift, groups_at, columns, n_groups = 0, None, 1, 1
    if top and bits.read(1):
        shift = bits.read(3) + 2
        columns, rows = (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
        groups_at = ((_image(bits, columns, rows, False) >> 8) & 0xFFFF).tolist()
        n_groups = max(groups_at) + 1
    return Codes(cache_bits, shift, columns, groups_at, [_group(bits, cache_bits) for _ in range(n_groups)])


def _image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    return _pixels(bits, _codes(bits, width, height, top), width, height)


def _pixels(bits: Bits, codes: Codes, width: int, height: int) -> np.ndarray:
    """The pixels of an entropy-coded image, one by one: uint32 ARGB in raster order."""
    cache_bits, shift, columns, groups_at, groups = codes.cache_bits, codes.shift, codes.columns, codes.groups_at, codes.groups
    n, out, k = width * height, [0] * (width * height), 0
    cache, cached_to = [0] * (1 << cache_bits), 0
    green, red, blue, alpha, dist = groups[0]
    while k < n:
        if groups_at is not None:
            y, x = divmod(k, width)
            green, red, blue, alpha, dist = groups[groups_at[(y >> shift) * columns + (x >> shift)]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[k] = a << 24 | r << 16 | s << 8 | b
            k += 1
        elif s < 280:
            length = _amount(bits, s - 256)
            d = _distance(_amount(bits, dist.read(bits)), width)
            if d > k or k + length > n:
                raise ValueError("back-reference out of range")
            for j in range(k, k + length):
                out[j] = out[j - d]
            k += length
        else:
            while cached_to < k:
                cache[(0x1E35A7BD * out[cached_to] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached_to]
                cached_to += 1
            if s - 280 >= len(cache):
                raise ValueError("no such cache entry")
            out[k] = cache[s - 280]
            k += 1
    return np.array(out, np.uint32)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


#: Lengths and distances of prefix symbols: extra bits, and the value with all of them 0.
_EXTRA = np.array([0 if c < 4 else (c - 2) >> 1 for c in range(40)], np.uint64)
_BASE = np.array([c + 1 if c < 4 else ((2 + (c & 1)) << ((c - 2) >> 1)) + 1 for c in range(40)], np.int64)
_LOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)
_NEAR_X, _NEAR_Y = (np.array([p[k] for p in NEAR], np.int64) for k in range(2))
#: Fewer images than these are followed one by one.
FEWEST = 120


def _table(code: PrefixCode) -> tuple[np.ndarray, np.uint64]:
    """Symbol and number of bits (the lowest four bits of an entry) by the next bits, and the mask for these."""
    if code.only is not None:
        return np.array([code.only << 4]), np.uint64(0)
    return code.symbol.astype(np.int64) << 4 | code.length, np.uint64((1 << code.width) - 1)


def _greens(stream: np.ndarray, places: np.ndarray, counts: np.ndarray, widths: np.ndarray, green: PrefixCode, dist: PrefixCode) -> np.ndarray:
    """The green samples of images in one byte stream whose pixels begin at the bit places, one image after the other."""
    padded = np.concatenate([stream, np.zeros(16, np.uint8)])
    words = np.ndarray(len(stream) + 9, "<u8", padded, 0, (1,))
    (g_table, g_mask), (d_table, d_mask) = _table(green), _table(dist)
    last = len(stream) * 8
    firsts = np.cumsum(counts) - counts
    place, here, end, first, width = places.astype(np.int64), firsts.copy(), firsts + counts, firsts.copy(), widths.astype(np.int64)
    out = np.zeros(int(counts.sum()), np.uint8)
    while len(here) >= FEWEST:
        w = words[place >> 3] >> (place & 7).view(np.uint64)
        entry = g_table[w & g_mask]
        symbol, used = entry >> 4, entry & 15
        step = 1
        c = np.flatnonzero(symbol >= 256)
        # Where a copy comes, the value written here is overwritten by it.
        out[here] = symbol.astype(np.uint8)
        if len(c):
            s = symbol[c] - 256
            extra = _EXTRA[s]
            w2 = w[c] >> used[c].view(np.uint64)
            length = _BASE[s] + (w2 & _LOW[extra]).view(np.int64)
            w2 >>= extra
            entry = d_table[w2 & d_mask]
            d, bits = entry >> 4, entry & 15
            more = _EXTRA[d]
            away = _BASE[d] + (w2 >> bits.view(np.uint64) & _LOW[more]).view(np.int64) - 120
            used[c] += bits + (extra + more).view(np.int64)
            at = here[c]
            if away.min() <= 0:
                near = np.flatnonzero(away <= 0)
                away[near] = np.maximum(1, _NEAR_X[away[near] + 119] + _NEAR_Y[away[near] + 119] * width[c[near]])
            if (away > at - first[c]).any() or (at + length > end[c]).any():
                raise ValueError("back-reference out of range")
            step = np.ones(len(here), np.int64)
            step[c] = length
            ends = np.cumsum(length)
            inner = np.arange(ends[-1]) - np.repeat(ends - length, length)
            target = np.repeat(at, length) + inner
            # A copy that reaches into itself repeats what it began with.
            if (away < length).any():
                inner %= np.repeat(away, length)
            out[target] = out[np.repeat(at - away, length) + inner]
        here = here + step
        place = place + used
        more = here < end
        if not more.all():
            if (place > last).any():
                raise ValueError("truncated image")
            place, here, end, first, width = place[more], here[more], end[more], first[more], width[more]
        elif place.max() > last:
            raise ValueError("truncated image")
    whole = padded.tobytes() if len(here) else b""
    for p, k, e, f, w in zip(place.tolist(), here.tolist(), end.tolist(), first.tolist(), width.tolist(), strict=True):
        image = bytearray(out[f:e].tobytes())
        _follow(whole, p, image, k - f, w, green, dist, last)
        out[f:e] = np.frombuffer(image, np.uint8)
    return out


def _follow(data: bytes, place: int, image: bytearray, k: int, width: int, green: PrefixCode, dist: PrefixCode, last: int) -> None:
    """Fill one image from a token on."""
    pairs, mask = green.pairs, (1 << green.width) - 1
    d_pairs, d_mask = (dist.pairs, (1 << dist.width) - 1) if dist.only is None else ([(dist.only, 0)], 0)
    extra, base, end = _EXTRA.tolist(), _BASE.tolist(), len(image)
    while k < end:
        w = int.from_bytes(data[place >> 3 : (place >> 3) + 8], "little") >> (place & 7)
        s, n = pairs[w & mask]
        place += n
        if s < 256:
            image[k] = s
            k += 1
            continue
        w >>= n
        e = extra[s - 256]
        length = base[s - 256] + (w & ((1 << e) - 1))
        w >>= e
        d, n = d_pairs[w & d_mask]
        f = extra[d]
        away = _distance(base[d] + (w >> n & ((1 << f) - 1)), width)
        place += e + n + f
        if away > k or k + length > end:
            raise ValueError("back-reference out of range")
        if place > last:
            raise ValueError("truncated image")
        part = image[k - away : k - away + length]
        image[k : k + length] = part if away >= length else (part[:away] * (length // away + 1))[:length]
        k += length
    if place > last:
        raise ValueError("truncated image")


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) bytes as blue, green, red, alpha."""
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4)


def _blocks(shape: tuple[int, int], size_bits: int, part: np.ndarray) -> np.ndarray:
    """The block's element for every pixel."""
    h, w = shape
    columns = (w + (1 << size_bits) - 1) >> size_bits
    return part.reshape(-1, columns, part.shape[-1])[np.arange(h)[:, None] >> size_bits, np.arange(w)[None] >> size_bits]


def _predict(mode: int, left: list, top: list, top_right: list, top_left: list) -> list:
    avg = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return avg(avg(left, top_right), top)
    if mode == 6:
        return avg(left, top_left)
    if mode == 7:
        return avg(left, top)
    if mode == 8:
        return avg(top_left, top)
    if mode == 9:
        return avg(top, top_right)
    if mode == 10:
        return avg(avg(left, top_left), avg(top, top_right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        by_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(avg(left, top), top_left, strict=True)]
    return [0, 0, 0, 255]


def _undo_predictor(bgra: np.ndarray, width: int, height: int, size_bits: int, part: np.ndarray) -> np.ndarray:
    modes = _blocks((height, width), size_bits, _channels(part))[:, :, 1].tolist()
    rest, out = bgra.tolist(), []
    for k, pixel in enumerate(rest):
        y, x = divmod(k, width)
        if not k:
            guess = [0, 0, 0, 255]
        elif not y:
            guess = out[-1]
        elif not x:
            guess = out[k - width]
        else:
            guess = _predict(modes[y][x], out[k - 1], out[k - width], out[k - width + 1], out[k - width - 1])
        out.append([(p + g) & 255 for p, g in zip(pixel, guess, strict=True)])
    return np.array(out, np.uint8)


def _undo_cross_colour(bgra: np.ndarray, width: int, height: int, size_bits: int, part: np.ndarray) -> np.ndarray:
    by = _blocks((height, width), size_bits, _channels(part)).reshape(-1, 4).astype(np.int8).astype(np.int32)
    delta = lambda t, c: (t * c.astype(np.int8).astype(np.int32)) >> 5
    blue, green, red = (bgra[:, k].astype(np.int32) for k in range(3))
    red = (red + delta(by[:, 0], green)) & 255
    blue = (blue + delta(by[:, 1], green) + delta(by[:, 2], red)) & 255
    return np.stack([blue, green, red, bgra[:, 3].astype(np.int32)], 1).astype(np.uint8)


def palette_share(colours: int) -> int:
    """Binary logarithm of how many pixels share a byte."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(bgra: np.ndarray, packed_width: int, width: int, height: int, table: np.ndarray) -> np.ndarray:
    share = palette_share(len(table))
    index = bgra[:, 1].reshape(height, packed_width)
    if share:
        width_bits = 8 >> share
        places = (np.arange(1 << share) * width_bits).astype(np.uint8)
        index = ((index[:, :, None] >> places) & ((1 << width_bits) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index.reshape(-1)]


def image_chunk(data: bytes) -> tuple[bytes, int]:
    """The VP8L chunk of the RIFF file at the start of data, and the file's size."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    size = 8 + int.from_bytes(data[4:8], "little")
    at = 12
    while at + 8 <= size:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + n], size
        at += 8 + n + (n & 1)
    raise ValueError("no lossless image")


@dataclass
class Picture:
    """An image up to its pixels: sizes, transforms to undo in reverse order, the width they leave, and its codes."""

    width: int
    height: int
    opaque: bool
    undo: list
    packed_width: int
    codes: Codes
    bits: Bits


def parse(data: bytes) -> Picture:
    chunk, _ = image_chunk(data)
    if not chunk or chunk[0] != SIGNATURE:
        raise ValueError("bad signature")
    bits = Bits(chunk, 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            side = (1 << size_bits) - 1
            part = _image(bits, (now + side) >> size_bits, (height + side) >> size_bits, False)
            undo.append((_undo_predictor if kind == PREDICTOR else _undo_cross_colour, (now, height, size_bits, part)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_undo_subtract_green, ()))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_image(bits, n, 1, False)), 0, dtype=np.int64).astype(np.uint8)
            share = palette_share(n)
            packed = (now + (1 << share) - 1) >> share
            undo.append((_undo_palette, (packed, now, height, table)))
            now = packed
    return Picture(width, height, opaque, undo, now, _codes(bits, now, height, True), bits)


def _undo_subtract_green(bgra: np.ndarray) -> np.ndarray:
    out = bgra.copy()
    out[:, 0] += bgra[:, 1]
    out[:, 2] += bgra[:, 1]
    return out


def _finished(p: Picture, bgra: np.ndarray) -> np.ndarray:
    for f, args in reversed(p.undo):
        bgra = f(bgra, *args)
    out = bgra[:, ::-1].reshape(p.height, p.width, 4)
    if p.opaque:
        out = out.copy()
        out[:, :, 0] = 255
    return out


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Of each file (height, width, 4) bytes in the order alpha, red, green, blue."""
    pictures = [parse(f) for f in files]
    out: list[np.ndarray | None] = [None] * len(files)
    together: dict[int, list[int]] = {}
    for k, p in enumerate(pictures):
        if p.codes.side_by_side():
            together.setdefault(id(p.codes.groups[0]), []).append(k)
        else:
            out[k] = _finished(p, _channels(_pixels(p.bits, p.codes, p.packed_width, p.height)))
    for some in together.values():
        group = pictures[some[0]].codes.groups[0]
        sizes = np.array([len(pictures[k].bits.data) for k in some])
        starts = np.cumsum(sizes) - sizes
        places = 8 * starts + np.array([pictures[k].bits.at for k in some])
        counts = np.array([pictures[k].packed_width * pictures[k].height for k in some])
        widths = np.array([pictures[k].packed_width for k in some])
        greens = _greens(np.frombuffer(b"".join(pictures[k].bits.data for k in some), np.uint8), places, counts, widths, group[0], group[4])
        for k, a, n in zip(some, (np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
            bgra = np.empty((n, 4), np.uint8)
            bgra[:, 0], bgra[:, 1], bgra[:, 2], bgra[:, 3] = group[2].only, greens[a : a + n], group[1].only, group[3].only
            out[k] = _finished(pictures[k], bgra)
    return out


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) bytes in the order alpha, red, green, blue."""
    return decode_many([data])[0]


class BitWriter:
    """Collects bits, least significant first."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= (value & ((1 << n) - 1)) << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def huffman_lengths(weights, longest: int = MAX_CODE) -> np.ndarray:
    """Lengths of a Huffman code; weights are flattened until no code is longer than `longest`."""
    import heapq

    weights = np.asarray(weights, np.int64).copy()
    used = np.flatnonzero(weights)
    out = np.zeros(len(weights), np.int64)
    if len(used) == 1:
        out[used] = 1
        return out
    while True:
        heap = [(int(weights[s]), k, (int(s),)) for k, s in enumerate(used)]
        heapq.heapify(heap)
        out[:] = 0
        k = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        if out.max() <= longest:
            return out
        weights[used] = weights[used] // 2 + 1


def put_prefix_code(w: BitWriter, lengths) -> None:
    """A prefix code in the normal form, without run lengths."""
    lengths = [int(x) for x in lengths]
    counts = np.bincount(lengths, minlength=19)
    if np.count_nonzero(counts) == 1:
        counts[(lengths[0] + 1) % 16] += 1
    of = huffman_lengths(counts, 7)
    codes = canonical(of)
    w.put(0, 1)
    w.put(15, 4)
    for k in CODE_LENGTH_ORDER:
        w.put(int(of[k]), 3)
    w.put(0, 1)
    for n in lengths:
        w.put(int(codes[n]), int(of[n]))


#: Width of a payload's image, and its most rows: a longer payload becomes several images, read side by side.
ROW, ROWS = 576, 24
#: The longest code of the payload codes, so that their tables stay in a CPU's cache.
LONGEST = 12
#: Bytes of a back-reference at least and at most; short ones far away cost more than their literals.
SHORTEST, SHORT_REACH, LONGEST_COPY = 4, 512, 128


def _green_weights() -> np.ndarray:
    """How often each byte, and each length of a back-reference, is expected in text in any alphabet: a rule, not a count."""
    w = np.full(280, 4, np.int64)
    w[0x80:0xC0] = 24
    w[0xC3] = 60
    for c in range(ord("0"), ord("9") + 1):
        w[c] = 40
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        w[c] = 30
    for c in b"abcdefghijklmnopqrstuvwxyz":
        w[c] = 90
    for c in b"etaoinshr":
        w[c] = 250
    w[ord(" ")] = 400
    for c in b".,\n":
        w[c] = 60
    # Lengths from SHORTEST on, the longer the rarer.
    for prefix in range(3, 24):
        w[256 + prefix] = max(4, 900 >> max(0, (prefix - 4) // 2))
    return w


def _distance_weights() -> np.ndarray:
    """Distances are sent as themselves and 120: most lie within some thousand bytes."""
    w = np.full(40, 1, np.int64)
    for prefix in range(13, 33):
        w[prefix] = 40 if prefix < 15 else 200
    return w


GREEN, DISTANCE = huffman_lengths(_green_weights(), LONGEST), huffman_lengths(_distance_weights(), LONGEST)
GREEN_CODES, DISTANCE_CODES = canonical(GREEN).astype(np.uint64), canonical(DISTANCE).astype(np.uint64)


def _put_single(w: BitWriter, symbol: int) -> None:
    w.put(1, 1)
    w.put(0, 1)
    w.put(int(symbol > 1), 1)
    w.put(symbol, 8 if symbol > 1 else 1)


def _put_text_codes(w: BitWriter) -> None:
    """No colour cache, one group: green and distances under the text codes, nothing in red and blue, full alpha."""
    w.put(0, 2)
    put_prefix_code(w, GREEN)
    for symbol in (0, 0, 255):
        _put_single(w, symbol)
    put_prefix_code(w, DISTANCE)


def _grey_header() -> BitWriter:
    w = BitWriter()
    w.put(1, 1)
    w.put(SUBTRACT_GREEN, 2)
    w.put(0, 1)
    _put_text_codes(w)
    return w


def _palette_header(values: np.ndarray) -> BitWriter:
    """Header of an image of few grey colours: a table of their differences under flat codes."""
    w = BitWriter()
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(values) - 1, 8)
    w.put(0, 1)
    flat = canonical([8] * 256)
    put_prefix_code(w, [8] * 256 + [0] * 24)
    for _ in range(2):
        put_prefix_code(w, [8] * 256)
    lengths = np.zeros(256, np.int64)
    lengths[[0, 255]] = 1
    put_prefix_code(w, lengths)
    _put_single(w, 0)
    for k, d in enumerate(np.diff(values.astype(np.int64), prepend=0).tolist()):
        for _ in range(3):
            w.put(int(flat[d & 255]), 8)
        w.put(int(k == 0), 1)  # alpha 255 first, and no difference after
    w.put(0, 1)
    _put_text_codes(w)
    return w


_GREY = _grey_header()


def _matches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of a back-reference, 0 if none pays, and how far it reaches. ends has the end of each place's image."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray(n + 9, "<u8", padded, 0, (1,))
    four = words[:n].astype(np.uint32)
    key = ((four * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    here, before = order[1:][same], order[:-1][same]
    fine = (ends[before] == ends[here]) & (four[before] == four[here]) & (here + SHORTEST <= ends[here])
    here, before = here[fine], before[fine]
    reach = np.zeros(n, np.int32)
    reach[here] = here - before
    # Where the places that follow reach back as far, the reference goes on over them.
    last = np.append(np.flatnonzero(reach[1:] != reach[:-1]), n - 1)
    length = np.minimum(np.repeat(last, np.diff(last, prepend=-1)) - np.arange(n) + SHORTEST, LONGEST_COPY)
    pays = (reach > 0) & ((length > SHORTEST) | (reach < SHORT_REACH))
    return np.where(pays, length, 0), reach


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and their value, of lengths or distances from 1 on."""
    x = value.astype(np.int64) - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.maximum(high - 1, 0)
    symbol = np.where(x < 4, x, 2 * high + (x >> extra & 1))
    extra = np.where(x < 4, 0, extra)
    return symbol, extra, np.where(x < 4, 0, x & ((1 << extra) - 1))


#: Doublings of the jump table of the greedy parse.
_DOUBLINGS = 6


def _parsed(step: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places that steps from the start of each image reach; no step leaves its image."""
    n = len(step)
    jump = np.append(np.arange(n, dtype=np.int32) + step, n).astype(np.int32)
    jumps = [jump]
    for _ in range(_DOUBLINGS):
        jumps.append(jumps[-1][jumps[-1]])
    here, end, anchors, ends = at[:-1].astype(np.int32), at[1:], [], []
    while len(here):
        anchors.append(here)
        ends.append(end)
        here = jumps[-1][here]
        more = here < end
        here, end = here[more], end[more]
    anchors, ends = np.concatenate(anchors), np.concatenate(ends)
    order = np.argsort(anchors, kind="stable")
    places, ends = anchors[order][:, None], ends[order]
    for j in reversed(jumps[:-1]):
        places = np.stack([places, j[places]], 2).reshape(len(anchors), -1)
    # What lies behind an image's end is reached from the next image's start as well.
    return places[places < ends[:, None]].astype(np.int64)


def _pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with their numbers of bits, in order, and the n+1 code offsets of the images."""
    lengths, reach = _matches(data, np.repeat(at[1:], np.diff(at)))
    places = _parsed(np.maximum(lengths, 1), at)
    copy = lengths[places] > 0
    value, bits = GREEN_CODES[data[places]], GREEN[data[places]]
    length, reach = lengths[places[copy]], reach[places[copy]].astype(np.int64)
    symbol, extra, low = _prefix(length)
    value[copy] = GREEN_CODES[256 + symbol] | low.astype(np.uint64) << GREEN[256 + symbol].astype(np.uint64)
    bits[copy] = GREEN[256 + symbol] + extra
    symbol, extra, low = _prefix(reach + 120)
    far = DISTANCE_CODES[symbol] | low.astype(np.uint64) << DISTANCE[symbol].astype(np.uint64)
    # A copy's distance follows its length.
    slot = np.arange(len(places)) + np.cumsum(copy) - copy
    values, widths = np.zeros(len(places) + int(copy.sum()), np.uint64), np.zeros(len(places) + int(copy.sum()), np.int64)
    values[slot], widths[slot] = value, bits
    values[slot[copy] + 1], widths[slot[copy] + 1] = far, DISTANCE[symbol] + extra
    first = np.searchsorted(places, at)
    return values, widths, np.append(slot, len(values))[first]


def _pack(codes: np.ndarray, places: np.ndarray, n_bits: int) -> np.ndarray:
    """Codes of up to 32 bits laid at bit places (ascending, not overlapping) as bytes."""
    words = np.zeros(n_bits // 32 + 2, np.uint64)
    word = places >> 5
    shifted = codes << (places & 31).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.bitwise_or.reduceat(shifted, first)
    words[word[first]] |= sums & np.uint64(0xFFFFFFFF)
    words[word[first] + 1] |= sums >> np.uint64(32)
    return words.astype("<u4").view(np.uint8)


def _files(data: np.ndarray, at: np.ndarray, headers: list[BitWriter], rows: np.ndarray) -> list[bytes]:
    """A file for each row of green samples."""
    values, widths, first = _pieces(data, at)
    upto = np.concatenate([[0], np.cumsum(widths)])
    bits = np.diff(upto[first])
    head = np.array([h.size for h in headers])
    # Image bits begin after signature, sizes and version: 5 bytes.
    chunk = 5 + (head + bits + 7) // 8
    starts = np.concatenate([[0], np.cumsum(chunk)])
    base = 8 * (starts[:-1] + 5) + head - upto[first[:-1]]
    out = _pack(values, upto[:-1] + np.repeat(base, np.diff(first)), 8 * int(starts[-1]))[: starts[-1]].copy()
    whole, files = out.tobytes(), []
    for k, h in enumerate(headers):
        a, b = int(starts[k]), int(starts[k + 1])
        start = a + 5 + h.size // 8
        # The header's last byte shares its bits with the first code.
        body = h.bytes()[: h.size // 8] + (bytes([h.bytes()[-1] | whole[start]]) + whole[start + 1 : b] if h.size % 8 else whole[start:b])
        chunk_bytes = bytes([SIGNATURE]) + (ROW - 1 | int(rows[k] - 1) << 14).to_bytes(4, "little") + body
        size = len(chunk_bytes)
        files.append(b"RIFF" + (12 + size + (size & 1)).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + chunk_bytes + b"\0" * (size & 1))
    return files


def _with_palette(data: np.ndarray) -> bytes | None:
    """A payload's file with a palette, if it has 16 values at most."""
    values = np.flatnonzero(np.bincount(data, minlength=256))
    if len(values) > 16:
        return None
    share = palette_share(len(values))
    index = np.searchsorted(values, data).reshape(-1, 1 << share)
    packed = (index << (np.arange(1 << share) * (8 >> share))).sum(1).astype(np.uint8)
    return _files(packed, np.array([0, len(packed)]), [_palette_header(values)], np.array([len(data) // ROW]))[0]


def encode_payloads(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """One WebP file for each row of bytes; rows have a positive multiple of ROW bytes, ROW * ROWS at most."""
    sizes = np.diff(at)
    if not len(sizes):
        return []
    if (sizes <= 0).any() or (sizes % ROW).any() or (sizes > ROW * MAX_SIDE).any():
        raise ValueError("a payload image takes 1 to 16384 whole rows")
    files = _files(data, at, [_GREY] * len(sizes), sizes // ROW)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        # Few values show in the first row already.
        if len(np.unique(data[a : a + ROW])) <= 16:
            other = _with_palette(data[a:b])
            if other is not None and len(other) < len(files[k]):
                files[k] = other
    return files


def decode_payloads(files: list[bytes]) -> list[bytes]:
    """The payload rows (green samples) of each file."""
    return [p[:, :, 2].tobytes() for p in decode_many(files)]
