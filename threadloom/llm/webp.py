"""Lossless WebP: a decoder for the whole bitstream, a compact encoder, and a column operator over stored images.

Decoding reads prefix codes (simple and canonical, with meta codes), literals, back-references and the colour cache, and
then inverts the predictor, cross-colour, subtract-green and palette transforms; the result is an array of ARGB pixels.
The encoder writes grey images: subtract-green and palette transforms (bundling indices of small palettes), one group of
prefix codes, and back-references for lines that came before. `encode_argb` writes any pixels with chosen transforms.

Format: public WebP lossless bitstream specification.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, over_texts

#: Samples per row; rows per image at most (the format's limit is 16 384).
WIDTH, MAX_ROWS = 192, 16_383
#: Longest code the encoder uses, and the bits that one look-up of the decoder sees at least.
MAX_CODE = 11
#: Pixels from which look-ups of several symbols pay.
MANY = 600
#: Bits for which look-ups are made at once.
SEGMENT = 1 << 16

# Fixed values of the format: the order in which lengths of the code-length code are stored.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Short distance codes: neighbours by distance, then by |x|, the right one first.
NEIGHBOURS = sorted([(x, 0) for x in range(1, 9)] + [(x, y) for y in range(1, 8) for x in range(-7, 9)], key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))

PREDICTOR, CROSS, SUBTRACT_GREEN, PALETTE = range(4)


class BadImage(ValueError):
    pass


# ---------------------------------------------------------------- reading


class Bits:
    """Little-endian bit reader over bytes."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint64)
        n = len(b) - 4
        w = b[:n] | b[1 : n + 1] << np.uint64(8) | b[2 : n + 2] << np.uint64(16) | b[3 : n + 3] << np.uint64(24) | b[4 : n + 4] << np.uint64(32)
        self.array = w.view(np.int64)
        self.words, self.at, self.end = w.tolist(), 0, 8 * len(data)

    def read(self, n: int) -> int:
        p = self.at
        if p + n > self.end:
            raise BadImage("the stream ends early")
        self.at = p + n
        return self.words[p >> 3] >> (p & 7) & ((1 << n) - 1)


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with a code, their lengths and their canonical codes, bits reversed as stored."""
    used = np.flatnonzero(lengths)
    size = lengths[used]
    order = np.argsort(size, kind="stable")
    used, size = used[order], size[order]
    if not len(used):
        return used, size, size
    top = int(size[-1])
    step = np.int64(1) << (top - size)
    full = np.cumsum(step) - step  # code, left-aligned to top bits
    if full[-1] + step[-1] != 1 << top and len(used) > 1:
        raise BadImage("a prefix code is not complete")
    rev = np.zeros_like(full)
    for k in range(top):
        rev |= (full >> k & 1) << (top - 1 - k)
    return used, size, rev


class Code:
    """A prefix code as a table over `bits` bits: symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used, size, rev = _codes(lengths)
        if len(used) < 2:
            self._one(int(used[0]) if len(used) else 0)
            return
        self.only, self.bits = None, int(size[-1])
        t = np.zeros(1 << self.bits, np.int64)
        for s, n, r in zip(used.tolist(), size.tolist(), rev.tolist()):
            t[r :: 1 << n] = s << 4 | n
        self.array = t
        self.table = t.tolist()

    def _one(self, symbol: int) -> None:
        self.bits, self.only, self.table = 0, symbol, [symbol << 4]

    @classmethod
    def of_one(cls, symbol: int) -> Code:
        code = cls.__new__(cls)
        code._one(symbol)
        return code

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1


@functools.lru_cache(maxsize=1024)
def _small_code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.int64))


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two:
            return Code.of_one(first)
        lengths = np.zeros(256, np.int64)
        lengths[[first, bits.read(8)]] = 1
        return Code(lengths)
    small = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        small[CODE_ORDER[k]] = bits.read(3)
    code = _small_code(small.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    out: list[int] = []
    last, table, mask = 8, code.table, code.mask
    while len(out) < alphabet and left:
        left -= 1
        e = table[bits.words[bits.at >> 3] >> (bits.at & 7) & mask]
        bits.at += e & 15
        s = e >> 4
        if s < 16:
            out.append(s)
            last = s or last
        elif s == 16:
            out += [last] * (3 + bits.read(2))
        else:
            out += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(out) > alphabet:
        raise BadImage("too many code lengths")
    return Code(np.array(out + [0] * (alphabet - len(out)), np.int64))


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def _greens(bits: Bits, code: Code, distances: Code, width: int, n: int) -> bytearray:
    """The green samples of n pixels whose other channels take no bits: several literals per look-up."""
    many = 1
    if n >= MANY:
        size = max(code.bits, 11 if n < 12_000 else 13 if n < 50_000 else 15)
        one = np.tile(code.array, 1 << (size - code.bits)) if size > code.bits else code.array
        # literals: bytes << 16 | count << 8 | bits; else -1. `step` is that for one symbol, and 0 for others
        sym, used = one >> 4, one & 15
        step = np.where(sym < 256, sym << 16 | 256 | used, 0)
        index, all_ = np.arange(1 << size), step.copy()
        for k in range(1, 4 if size > 11 else 3):
            nxt = step[index >> used]
            fits = (nxt > 0) & (used + (nxt & 255) <= size) & (all_ >> 8 & 255 == k)
            all_ += np.where(fits, (nxt >> 16 << 8 * k + 16) + (nxt & 0xFFFF), 0)
            used = all_ & 255
        mask, many = (1 << size) - 1, 4 if size > 11 else 3
    out, p, words, single, small = bytearray(), bits.at, bits.words, code.table, code.mask
    low, eight, four = -SEGMENT, np.arange(8), np.arange(4)
    add = out.append
    while (have := len(out)) < n:
        while many > 1 and n - have >= 4 * many:
            # look-ups at all bit positions of a segment; following them is then a walk over positions, which stops
            # (stays where it is) at the segment's end or at a symbol that is no literal
            if not low <= p < low + SEGMENT:
                low = p & ~7
                part = bits.array[low >> 3 : (low + SEGMENT >> 3)]
                entry = all_[(part[:, None] >> eight & mask).ravel()]
                at = np.arange(len(entry) + 64)
                at[: len(entry)] += entry & 255
                follow = memoryview(at)
            q, walked = p - low, []
            add_at = walked.append
            for _ in range(min(1024, (n - have) // many)):
                add_at(q)
                q = follow[q]
            spots = np.array(walked)
            fixed = at[spots] == spots
            spots = spots[: int(np.argmax(fixed))] if fixed[-1] else spots
            e = entry[spots]
            sizes = e >> 8 & 255
            out += ((e >> 16).astype("<u4").view(np.uint8).reshape(-1, 4)[four < sizes[:, None]]).tobytes()
            have, p = len(out), q + low
            if fixed[-1] and q < len(entry):
                break
        if have == n:
            break
        e = single[words[p >> 3] >> (p & 7) & small]
        p += e & 15
        s = e >> 4
        if s < 256:
            add(s)
            continue
        if s >= 280:
            raise BadImage("a colour cache index without a cache")
        bits.at = p
        length = _value(bits, s - 256)
        e = distances.table[words[bits.at >> 3] >> (bits.at & 7) & distances.mask]
        bits.at += e & 15
        back = _distance(_value(bits, e >> 4), width)
        p, have = bits.at, len(out)
        if back > have or have + length > n:
            raise BadImage("a back-reference leaves the image")
        if back >= length:
            out += out[have - back : have - back + length]
        else:
            out += (out[have - back :] * (length // back + 1))[:length]
    bits.at = p
    if p > bits.end:
        raise BadImage("the stream ends early")
    return out


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as rows of (alpha, red, green, blue)."""
    n = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("colour cache too large")
    groups, meta, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        mw, mh = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
        m = _pixels(bits, mw, mh, False)
        meta = (m[:, 1].astype(np.int64) << 8 | m[:, 2]).tolist()
        groups = max(meta) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, a) for a in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    g = codes[0]
    if groups == 1 and not cache_bits and not any(c.bits for c in g[1:4]):
        out = np.empty((n, 4), np.uint8)
        out[:] = (g[3].only, g[1].only, 0, g[2].only)
        out[:, 2] = g[0].only if not g[0].bits and g[0].only < 256 else np.frombuffer(_greens(bits, g[0], g[4], width, n), np.uint8)
        return out
    out: list[int] = []
    cache, cached = [0] * cache_size, 0
    shift = 32 - cache_bits
    words = bits.words

    def symbol(code: Code) -> int:
        if not code.bits:
            return code.only
        e = code.table[words[bits.at >> 3] >> (bits.at & 7) & code.mask]
        bits.at += e & 15
        return e >> 4

    while len(out) < n:
        k = len(out)
        if meta is not None:
            y, x = divmod(k, width)
            g = codes[meta[(y >> block) * mw + (x >> block)]]
        s = symbol(g[0])
        if s < 256:
            r = symbol(g[1])
            b = symbol(g[2])
            out.append(symbol(g[3]) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length = _value(bits, s - 256)
            back = _distance(_value(bits, symbol(g[4])), width)
            if back > k or k + length > n:
                raise BadImage("a back-reference leaves the image")
            for i in range(k, k + length):
                out.append(out[i - back])
        else:
            if s - 280 >= cache_size:
                raise BadImage("no such colour in the cache")
            while cached < k:
                c = out[cached]
                cache[(c * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = c
                cached += 1
            out.append(cache[s - 280])
        if bits.at > bits.end:
            raise BadImage("the stream ends early")
    return np.array(out, ">u4").view(np.uint8).reshape(n, 4)


# ---------------------------------------------------------------- transforms, inverted


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int16) + b) >> 1


def _predict(mode: int, left, top, top_right, top_left) -> np.ndarray:
    """The prediction from the neighbours, each of shape (k, 4)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    a, t, c = left.astype(np.int16), top.astype(np.int16), top_left.astype(np.int16)
    if mode == 11:
        by_left, by_top = np.abs(t - c).sum(1), np.abs(a - c).sum(1)
        return np.where((by_left < by_top)[:, None], a, t)
    if mode == 12:
        return np.clip(a + t - c, 0, 255)
    if mode == 13:
        m = _average(left, top)
        d = m - c
        return np.clip(m + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.uint8), left.shape)


def _unpredict(px: np.ndarray, modes: np.ndarray, block: int, inverse: bool = True) -> np.ndarray:
    """Pixels from residuals (or residuals from pixels), px of shape (h, w, 4). A pixel needs its left, top and top-right
    neighbours, so all pixels with the same x + 2y go in one step."""
    h, w, _ = px.shape
    out = px.copy()
    known = out if inverse else px
    sign = 1 if inverse else -1
    out[0, 0] = px[0, 0] + np.array([sign * 255 & 255, 0, 0, 0], np.uint8)
    for s in range(1, w + 2 * h - 2):
        y = np.arange(max(0, (s - w + 2) // 2), min(h - 1, s // 2) + 1)
        x = s - 2 * y
        ok = (x >= 0) & (x < w)
        y, x = y[ok], x[ok]
        if not len(y):
            continue
        mode = np.where(y == 0, 1, np.where(x == 0, 2, modes[y >> block, x >> block] % 14))
        up, lf = np.maximum(y - 1, 0), np.maximum(x - 1, 0)
        wrap = x + 1 == w
        left, top, tl = known[y, lf], known[up, x], known[up, lf]
        tr = np.where(wrap[:, None], known[y, 0], known[up, np.minimum(x + 1, w - 1)])
        for m in np.unique(mode):
            at = mode == m
            p = np.asarray(_predict(int(m), left[at], top[at], tr[at], tl[at])).astype(np.uint8)
            out[y[at], x[at]] = px[y[at], x[at]] + p if inverse else px[y[at], x[at]] - p
    return out


def _uncross(px: np.ndarray, elements: np.ndarray, block: int, inverse: bool = True) -> np.ndarray:
    h, w, _ = px.shape
    e = elements[np.arange(h)[:, None] >> block, np.arange(w)[None] >> block].view(np.int8).astype(np.int32)
    red_blue, green_blue, green_red = e[..., 1], e[..., 2], e[..., 3]
    signed = px.view(np.int8).astype(np.int32)
    out = px.copy()
    sign = 1 if inverse else -1
    red = (px[..., 1] + sign * (green_red * signed[..., 2] >> 5)).astype(np.uint8)
    true_red = (red if inverse else px[..., 1]).view(np.int8).astype(np.int32)
    out[..., 1] = red
    out[..., 3] = (px[..., 3] + sign * ((green_blue * signed[..., 2] >> 5) + (red_blue * true_red >> 5))).astype(np.uint8)
    return out


def _bundle(colours: int) -> int:
    """log2 of the indices that share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels, shape (h, w, 4), of a RIFF file with a VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise BadImage("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise BadImage("no signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("unknown version")
    steps, w, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            bw, bh = (w + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            steps.append((kind, w, block, _pixels(bits, bw, bh, False).reshape(bh, bw, 4)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = np.cumsum(_pixels(bits, n, 1, False), axis=0, dtype=np.uint8)
            steps.append((kind, w, _bundle(n), colours))
            w = (w + (1 << _bundle(n)) - 1) >> _bundle(n)
        else:
            steps.append((kind, w, 0, None))
    px = _pixels(bits, w, height, True).reshape(height, w, 4)
    for kind, w, arg, extra in reversed(steps):
        if kind == PREDICTOR:
            px = _unpredict(px, extra[..., 2], arg)
        elif kind == CROSS:
            px = _uncross(px, extra, arg)
        elif kind == SUBTRACT_GREEN:
            px = px.copy()
            px[..., 1] += px[..., 2]
            px[..., 3] += px[..., 2]
        else:
            index = px[..., 2]
            if arg:
                bits_each = 8 >> arg
                index = (index[..., None] >> (np.arange(1 << arg, dtype=np.uint8) * bits_each) & ((1 << bits_each) - 1)).reshape(height, -1)[:, :w]
            table = np.zeros((256, 4), np.uint8)
            table[: len(extra)] = extra
            px = table[index]
    return px


# ---------------------------------------------------------------- writing


class Out:
    """Values and their bit counts, packed at the end."""

    def __init__(self):
        self.values, self.sizes, self.few, self.few_sizes = [], [], [], []

    def put(self, value: int, size: int) -> None:
        self.few.append(value)
        self.few_sizes.append(size)

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.settle()
        self.values.append(values)
        self.sizes.append(sizes)

    def settle(self) -> None:
        if self.few:
            self.values.append(np.array(self.few, np.int64))
            self.sizes.append(np.array(self.few_sizes, np.int64))
            self.few, self.few_sizes = [], []

    def done(self) -> bytes:
        self.settle()
        v, n = np.concatenate(self.values), np.concatenate(self.sizes)
        end = np.cumsum(n)
        at = end - n
        wide = v << (at & 31)  # at most 32 + 31 bits
        word = at >> 5
        size = (int(end[-1]) >> 5) + 2
        # bits never overlap, so that sums (exact below 2 ** 53) join them
        low = np.bincount(word, (wide & 0xFFFFFFFF).astype(float), size)
        low[1:] += np.bincount(word, (wide >> 32).astype(float), size)[:-1]
        return low.astype("<u4").tobytes()[: -(-int(end[-1]) // 8)]


def code_lengths(counts: np.ndarray, most: int = MAX_CODE) -> np.ndarray:
    """Lengths of a prefix code for counts, none above most."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    c = counts[used].tolist()
    while True:
        heap = sorted((n, k) for k, n in enumerate(c))
        parent, nxt = [0] * (2 * len(c)), len(c)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heap[0]
            parent[a[1]] = parent[b[1]] = nxt
            heapq.heapreplace(heap, (a[0] + b[0], nxt))
            nxt += 1
        depth = [0] * nxt
        for k in range(nxt - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(c)]) <= most:
            lengths[used] = depth[: len(c)]
            return lengths
        c = [max(1, n >> 1) for n in c]


_FOUR_LENGTHS = [0 if s in (14, 15, 16) else 4 for s in CODE_ORDER]
_FOUR = {s: int(f"{k:04b}"[::-1], 2) for k, s in enumerate([*range(14), 17, 18])}


def _put_code(out: Out, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code for counts; returns per symbol its bits and its size (0 where only one symbol is used)."""
    used = np.flatnonzero(counts)
    codes, sizes = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        out.put(1 | int(used[0] if len(used) else 0) << 3 | 4, 11)  # simple, one symbol of 8 bits
        return codes, sizes
    lengths = code_lengths(counts)
    used, size, rev = _codes(lengths)
    if len(used) == 2 and used.max() < 256:
        out.put(3 | 4 | int(used[0]) << 3, 11)
        out.put(int(used[1]), 8)
    else:
        # the code-length code: 4 bits for each of 0 to 13, 17 and 18
        out.put(15 << 1, 5)
        out.few += _FOUR_LENGTHS
        out.few_sizes += [3] * 19
        out.put(0, 1)
        four = _FOUR
        vals, szs, zeros = [], [], 0

        def flush(zeros: int) -> None:
            while zeros:
                if zeros < 3:
                    vals.append(four[0]), szs.append(4)
                    zeros -= 1
                elif zeros < 11:
                    vals.append(four[17] | (zeros - 3) << 4), szs.append(7)
                    zeros = 0
                else:
                    run = min(zeros, 138)
                    vals.append(four[18] | (run - 11) << 4), szs.append(11)
                    zeros -= run

        last = -1
        for s in np.flatnonzero(lengths).tolist():
            flush(s - last - 1)
            vals.append(four[int(lengths[s])]), szs.append(4)
            last = s
        flush(len(lengths) - last - 1)
        out.few += vals
        out.few_sizes += szs
    if len(used) > 1:
        codes[used], sizes[used] = rev, size
    return codes, sizes


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number, of values from 1 on."""
    v = np.asarray(v, np.int64) - 1
    top = np.zeros_like(v)
    for k in (16, 8, 4, 2, 1):
        top += np.where(v >> top >= 1 << k, k, 0)
    second = v >> np.maximum(top - 1, 0) & 1
    extra = np.maximum(top - 1, 0)
    sym = np.where(v < 4, v, 2 * top + second)
    extra = np.where(v < 4, 0, extra)
    return sym, v - np.where(v < 4, v, (2 + second) << extra), extra


def _put_pixels(out: Out, px: np.ndarray, copies: list[tuple[int, int, int]], main: bool, cache_bits: int = 0) -> None:
    """One group of codes. px: (n, 4); copies: (at, length, back), in order, apart."""
    n = len(px)
    kind = np.zeros(n, np.int8)  # 1: within a copy; 2: from the cache
    for at, length, _ in copies:
        kind[at : at + length] = 1
    out.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        out.put(0, 1)
    green = px[:, 2].astype(np.int64)
    cache_size = 1 << cache_bits if cache_bits else 0
    if cache_bits:
        argb = np.ascontiguousarray(px).view(">u4").ravel().astype(np.int64)
        slot = (argb * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)
        cache = [0] * cache_size
        for k, (c, s) in enumerate(zip(argb.tolist(), slot.tolist())):
            if not kind[k] and cache[s] == c:
                kind[k], green[k] = 2, 280 + s
            cache[s] = c
    first, dists, told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(n)
    if copies:
        first = np.array([c[0] for c in copies], np.int64)
        lens, len_extra, len_bits = _prefix(np.array([c[1] for c in copies], np.int64))
        dists, dist_extra, dist_bits = _prefix(np.array([c[2] + 120 for c in copies], np.int64))
        green[first] = 256 + lens
        kind_start = kind.copy()
        kind_start[first] = 3
        told = np.flatnonzero(kind_start != 1)
    literal = kind == 0
    counts = [np.bincount(green[told], minlength=280 + cache_size)]
    for c in (1, 3, 0):
        column = px[:, c]
        counts.append(np.bincount(column[:1] if (column == column[0]).all() else column[literal], minlength=256))
    counts.append(np.bincount(dists, minlength=40))
    tables = [_put_code(out, c) for c in counts]
    cols_v, cols_n = [tables[0][0][green]], [tables[0][1][green]]
    for (codes, sizes), c in zip(tables[1:4], (1, 3, 0)):
        if sizes.any():
            cols_v.append(np.where(literal, codes[px[:, c]], 0))
            cols_n.append(np.where(literal, sizes[px[:, c]], 0))
    if len(copies):
        for v, b in ((len_extra, len_bits), (tables[4][0][dists], tables[4][1][dists]), (dist_extra, dist_bits)):
            col_v, col_n = np.zeros(n, np.int64), np.zeros(n, np.int64)
            col_v[first], col_n[first] = v, b
            cols_v.append(col_v), cols_n.append(col_n)
    if len(cols_v) == 1 and len(told) == n:
        out.many(cols_v[0], cols_n[0])
    else:
        v, b = np.stack(cols_v, 1)[told].ravel(), np.stack(cols_n, 1)[told].ravel()
        out.many(v, b)


def _riff(width: int, height: int, body: Out, head: Out) -> bytes:
    head.settle()
    body.settle()
    head.values += body.values
    head.sizes += body.sizes
    data = head.done()
    pad = len(data) & 1
    return b"RIFF" + (12 + len(data) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * pad


def _head(width: int, height: int) -> Out:
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1 | height - 1 << 14, 28)
    out.put(0, 4)
    return out


def _line_copies(flat: bytes) -> list[tuple[int, int, int]]:
    """Back-references (at, length, back) for lines that came before, up to 4096 samples each."""
    lines = flat.split(b"\n")
    if len(set(lines)) == len(lines):
        return []
    seen: dict[bytes, int] = {}
    out, at = [], 0
    for line in lines[:-1]:
        size = len(line) + 1
        if size >= 8:
            before = seen.get(line)
            if before is not None:
                for k in range(0, size, 4096):
                    if size - k >= 3:
                        out.append((at + k, min(4096, size - k), at - before))
            seen[line] = at
        at += size
    return out


def encode_grey(samples: bytes, width: int = WIDTH) -> bytes:
    """A grey image of rows of `width` samples."""
    height = len(samples) // width
    flat = np.frombuffer(samples, np.uint8)
    present = np.flatnonzero(np.bincount(flat, minlength=256))
    out = Out()
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(1 | PALETTE << 1 | len(present) - 1 << 3, 11)
    colours = np.zeros((len(present), 4), np.uint8)
    colours[:, 0], colours[:, 2] = 255, present
    _put_pixels(out, np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)), [], False)
    out.put(0, 1)
    rank = np.zeros(256, np.uint8)
    rank[present] = np.arange(len(present))
    index = rank[flat]
    b = _bundle(len(present))
    copies = []
    if b:
        per, each = 1 << b, 8 >> b
        rows = np.pad(index.reshape(height, width), ((0, 0), (0, -width % per))).reshape(height, -1, per)
        index = (rows << (np.arange(per, dtype=np.uint8) * each)).sum(2).astype(np.uint8).ravel()
    else:
        copies = _line_copies(samples)
    px = np.zeros((len(index), 4), np.uint8)
    px[:, 0], px[:, 2] = 255, index
    _put_pixels(out, px, copies, True)
    return _riff(width, height, out, _head(width, height))


def encode_argb(px: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, subtract: bool = False, block: int = 2, cache_bits: int = 0) -> bytes:
    """Any pixels (h, w, 4), with the transforms asked for: predictor holds a mode per block, cross an ARGB element per block."""
    h, w, _ = px.shape
    out = Out()
    if predictor is not None:
        out.put(1 | PREDICTOR << 1 | block - 2 << 3, 6)
        modes = np.zeros((*predictor.shape, 4), np.uint8)
        modes[..., 0], modes[..., 2] = 255, predictor
        _put_pixels(out, modes.reshape(-1, 4), [], False)
        px = _unpredict(px, predictor, block, inverse=False)
    if cross is not None:
        out.put(1 | CROSS << 1 | block - 2 << 3, 6)
        _put_pixels(out, cross.reshape(-1, 4), [], False)
        px = _uncross(px, cross, block, inverse=False)
    if subtract:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        px = px.copy()
        px[..., 1] -= px[..., 2]
        px[..., 3] -= px[..., 2]
    out.put(0, 1)
    _put_pixels(out, np.ascontiguousarray(px.reshape(-1, 4)), [], True, cache_bits)
    return _riff(w, h, out, _head(w, h))


# ---------------------------------------------------------------- the operator


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty), spaces appended up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def store(payload: bytes) -> bytes:
    """One WebP file per MAX_ROWS rows, one after the other (each says its size)."""
    step = WIDTH * MAX_ROWS
    return b"".join(encode_grey(payload[k : k + step]) for k in range(0, len(payload), step))


def load(media: bytes) -> np.ndarray:
    """The samples of stored files as rows of one array."""
    parts = []
    while media:
        size = 8 + int.from_bytes(media[4:8], "little")
        px = decode(media[:size])
        parts.append(px[..., 2])
        media = media[size:]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def feature(samples: np.ndarray) -> str:
    """Height, mean, and a 64-bit hash of which of 8 by 8 cells are brighter than the image."""
    h, w = samples.shape
    rows = np.add.reduceat(samples, np.arange(0, w, w // 8)[:8], axis=1, dtype=np.int64)
    at = np.minimum(np.arange(8) * h // 8, h - 1)
    cells = rows[at] if h < 8 else np.add.reduceat(rows, at, axis=0) / np.diff(np.append(at, h))[:, None]
    mean = rows.sum() / (h * w)
    return f"{h}:{mean:.4f}:{np.packbits(cells / (w // 8) > mean).tobytes().hex()}"


SCHEMA = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
MEDIA = pa.schema([("media", pa.binary())])


def to_media(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df and a binary column with each text stored as lossless WebP; returns its name too.

    Null and empty texts become one row of spaces; long texts become several files in one value; equal texts, equal bytes.
    """
    name = fresh(df, "media")
    return df.withColumn(name, over_texts(lambda ts: [[store(payload_of(t)) for t in ts]], MEDIA)(F.col(text))["media"]), name


def _digest(texts: list) -> list:
    rows = []
    for t in texts:
        media = store(payload_of(t))
        samples = load(media)
        back = samples.tobytes()
        rows.append((len((t or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
    return list(zip(*rows)) if rows else [[] for _ in SCHEMA]


def digests(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df and a struct column (SCHEMA): what storing each text and reading the stored bytes back gives."""
    name = fresh(df, "webp")
    return df.withColumn(name, over_texts(_digest, SCHEMA)(F.col(text))), name
