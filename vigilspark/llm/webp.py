"""Lossless WebP (VP8L): a decoder of the whole format and an encoder that tries the format's transforms on every image.

The decoder reads prefix codes, meta prefix images, back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.
Runs of literal pixels are decoded with array operations: the pixel step is computed
for every bit position of a window, then only the chain of real positions is followed.

Pixels are uint8 arrays (height, width, 4) in the order red, green, blue, alpha.
"""

from __future__ import annotations

import struct

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: order of code length codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MAX_BITS, MAX_COPY, MAX_SIDE = 15, 4096, 1 << 14
#: Bits of one window of the literal decoder: bounds its memory.
WINDOW = 1 << 17
#: Pixels that are stepped over at once where files are decoded side by side.
STRIDE = 8
#: Bits of the sides, which a file begins with, and codes that decode_many() keeps for the files that follow.
SIDE_BITS, KEPT_OPENINGS = 28, 8
#: Bits that an image has to save, about, for encode_many() to give it codes of its own, which are made and read one by one.
OWN_SAVES = 6000
#: Code lengths that the encoder uses at most.
ENCODER_BITS = 12
#: Bits of the colour cache in shared codes and in the trial of own codes; and the most pixels for each place of an own one.
SHARED_CACHE, TRIAL_CACHE, CACHE_SHARE = 7, 9, 64
#: Bits of a block's side in transforms; and what a code, each symbol of it and each gap between these take, about.
BLOCK_BITS, CODE_BITS, SYMBOL_BITS, GAP_BITS = 5, 75, 3.2, 5.0
#: Rows of 64 pixels that are tried at once.
TRIAL_ROWS = 1 << 12
#: What encode_many() tries on every image before its codes: nothing, or one of these transforms.
PLAIN, GREEN_OFF, CROSSED, PREDICTED = range(4)
#: Short distances by code: pixels left (x) and up (y), nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
_REVERSED = np.zeros(1 << MAX_BITS, np.uint16)
for _i in range(MAX_BITS):
    _REVERSED |= ((np.arange(1 << MAX_BITS) >> _i & 1) << (MAX_BITS - 1 - _i)).astype(np.uint16)
_CACHE_FACTOR = np.uint32(0x1E35A7BD)


class WebpError(ValueError):
    pass


class Code:
    """A canonical prefix code: symbol and length by the next `bits` bits of the stream."""

    __slots__ = ("bits", "length", "most", "symbol")

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.most = int(used[-1]) if len(used) else 0
        if len(used) < 2:
            self.bits, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0], np.int32), np.zeros(1, np.uint8)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        self.bits = int(lengths[used].max())
        share = 1 << (self.bits - lengths[order].astype(np.int64))
        if share.sum() != 1 << self.bits:
            raise WebpError("prefix code is not complete")
        turned = _REVERSED[: 1 << self.bits] >> (MAX_BITS - self.bits)
        self.symbol = np.repeat(order.astype(np.int32), share)[turned]
        self.length = np.repeat(lengths[order].astype(np.uint8), share)[turned]


class Reader:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)
        self.raw = np.frombuffer(self.data, np.uint8)
        self.codes: dict[tuple, Code] = {}
        self.window: tuple | None = None

    def read(self, n: int) -> int:
        k = self.at >> 3
        v = int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise WebpError("data ends early")
        return v

    def symbol(self, code: Code) -> int:
        if not code.bits:
            return int(code.symbol[0])
        k = self.at >> 3
        peek = int.from_bytes(self.data[k : k + 3], "little") >> (self.at & 7) & (1 << MAX_BITS) - 1
        i = peek & (1 << code.bits) - 1
        self.at += int(code.length[i])
        if self.at > self.end:
            raise WebpError("data ends early")
        return int(code.symbol[i])

    def code(self, size: int) -> Code:
        lengths = np.zeros(size, np.int64)
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            symbols = [self.read(8 if wide else 1), *([self.read(8)] if two else [])]
            lengths[symbols] = 1
            return Code(lengths)
        first = np.zeros(19, np.int64)
        for i in range(4 + self.read(4)):
            first[LENGTH_ORDER[i]] = self.read(3)
        by, left = Code(first), size
        if self.read(1):
            left = 2 + self.read(2 + 2 * self.read(3))
        mask, symbol, length = (1 << by.bits) - 1, by.symbol.tolist(), by.length.tolist()
        k = self.at >> 3
        v, at = int.from_bytes(self.data[k : k + 2 * size + 16], "little"), self.at & 7  # at most 14 bits a token
        got, i, last = [0] * size, 0, 8
        while i < size and left:
            left -= 1
            x = v >> at
            s = symbol[x & mask]
            at += length[x & mask]
            if s < 16:
                got[i] = s
                last, i = s or last, i + 1
                continue
            x, bits, least = v >> at, *((2, 3) if s == 16 else (3, 3) if s == 17 else (7, 11))
            n = least + (x & (1 << bits) - 1)
            at += bits
            if i + n > size:
                raise WebpError("too many code lengths")
            if s == 16:
                got[i : i + n] = [last] * n
            i += n
        self.at = 8 * k + at
        if self.at > self.end:
            raise WebpError("data ends early")
        used = tuple(got[: max((j for j in range(size) if got[j]), default=-1) + 1])
        if used not in self.codes:
            self.codes[used] = Code(np.array(used, np.int64))
        return self.codes[used]

    def value(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = prefix - 2 >> 1
        return (2 + (prefix & 1) << extra) + self.read(extra) + 1


def _steps(raw: np.ndarray, codes: list[Code]) -> tuple[np.ndarray, list, list]:
    """Of every bit position of raw: where the pixel after a literal or a place of the colour cache there begins, or -1 where neither begins; and by channel the places in the code's tables and the code lengths (None without bits)."""
    wide = raw.astype(np.int32)
    word = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    peek = np.empty((len(word), 8), np.int64)  # wide, as the places that are looked up are quickest
    for i in range(8):
        np.right_shift(word, i, out=peek[:, i])
    peek = peek.ravel()
    n = len(peek) - 64
    seen: dict[int, tuple] = {}  # equal codes share their tables
    for c in codes[:4]:
        if c.bits and id(c) not in seen:
            i = peek & (1 << c.bits) - 1
            seen[id(c)] = i, c.length.take(i, mode="clip")  # in range everywhere; clip is the quick way
    rows, step = ([seen[id(c)][k] if c.bits else None for c in codes[:4]] for k in (0, 1))
    nxt = np.arange(max(n, 0), dtype=np.int64)
    kinds = (codes[0].symbol > 255).view(np.int8) + (codes[0].symbol > 279)  # literal, back-reference, place of the cache
    kind = kinds[:1] if rows[0] is None else kinds.take(rows[0][: len(nxt)], mode="clip")
    after_green = None
    for c, s in enumerate(step):
        if s is not None:
            nxt += s.take(nxt, mode="clip")
        if not c and codes[0].most >= 280:
            after_green = nxt.copy()
    if after_green is not None:
        np.copyto(nxt, after_green, where=kind == 2)
    if codes[0].most > 255:
        np.copyto(nxt, -1, where=kind == 1)
    return nxt, rows, step


def _pixels_at(q: np.ndarray, codes: list[Code], rows: list, step: list) -> tuple[np.ndarray, np.ndarray | None]:
    """The pixels that begin at the bit positions q, as ARGB numbers, and the places of the colour cache where they stand (-1: a literal; None: all are literals)."""
    got = []
    for c in range(4):
        if rows[c] is None:
            got.append(np.full(len(q), codes[c].symbol[0], np.int32))
        else:
            got.append(codes[c].symbol.take(rows[c].take(q, mode="clip"), mode="clip"))
            q = q + step[c].take(q, mode="clip")
    green, red, blue, alpha = (x.astype(np.uint32) for x in got)
    place = np.maximum(got[0] - 280, -1) if codes[0].most >= 280 else None
    return alpha << 24 | red << 16 | (green & 255) << 8 | blue, place


def _places(argb: np.ndarray, bits: int) -> np.ndarray:
    """Where the colour cache keeps these pixels."""
    return (argb * _CACHE_FACTOR) >> np.uint32(32 - bits)


def _by_place(place: np.ndarray, image: np.ndarray | None) -> np.ndarray:
    """Positions by image and place of the colour cache, in the stream's order."""
    order = np.argsort(place.astype(np.uint16), kind="stable")
    if image is None or not len(image):
        return order
    kind = np.uint16 if image[-1] < 1 << 16 else np.int64
    return order[np.argsort(image.astype(kind)[order], kind="stable")]


def _recall(argb: np.ndarray, place: np.ndarray, bits: int, image: np.ndarray | None = None, cache: np.ndarray | None = None) -> np.ndarray:
    """argb with the pixels of the colour cache: of each place that stands for one, the last pixel before it that was kept there. image: ascending numbers of several images; cache: what it holds before and, changed, after."""
    literal = place < 0
    place = np.where(literal, _places(argb, bits), place).astype(np.int64)
    order = _by_place(place, image)
    key = (place if image is None else image << bits | place)[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    begin = np.repeat(first, np.diff(np.append(first, len(key))))
    last = np.maximum.accumulate(np.where(literal[order], np.arange(len(key)), -1))
    before = np.uint32(0) if cache is None else cache[place[order]]
    got = np.where(last >= begin, argb[order][last], before)
    out = np.empty_like(argb)
    out[order] = got
    if cache is not None:
        cache[key] = got  # of equal places the last stays
    return out


def _strides(nxt: np.ndarray) -> np.ndarray:
    """Where STRIDE pixels lead from every bit position: to one before the end of nxt, or -1."""
    n = len(nxt)
    far = np.append(np.minimum(nxt.view(np.uint64), np.uint64(n)), np.uint64(n)).view(np.int64)  # -1 is the greatest
    for _ in range(STRIDE.bit_length() - 1):
        far = far.take(far, mode="clip")
    far[far == n] = -1
    return far


def _follow_far(chain: memoryview, far: memoryview, p: int, stop: int, most: int, at: list[int], weight: list[int]) -> tuple[int, int]:
    """As _follow(), but of every STRIDE pixels only the first, where they are all there; weight: for how many each stands. Also returns the number of pixels."""
    left, begin = most, len(at)
    add = at.append
    while left >= STRIDE:
        q = far[p]
        if q < 0 or q > stop:
            break
        add(p)
        p = q
        left -= STRIDE
    weight += [STRIDE] * (len(at) - begin)
    begin = len(at)
    p = _follow(chain, p, stop, left, at)
    weight += [1] * (len(at) - begin)
    return p, most - left + len(at) - begin


def _all_positions(nxt: np.ndarray, at: list[int], weight: list[int]) -> np.ndarray:
    """The positions of all pixels that at and weight of _follow_far() stand for."""
    first, n = np.array(at, np.int64), np.array(weight, np.int64)
    out = np.repeat(first, n)
    place = np.cumsum(n) - n
    place, q = place[n > 1], first[n > 1]
    for i in range(1, STRIDE):
        q = nxt.take(q, mode="clip")
        out[place + i] = q
    return out


def _follow(chain: memoryview, p: int, stop: int, most: int, at: list[int]) -> int:
    """Append the positions of at most `most` literals from p on, and return where the chain ends."""
    add = at.append
    while p < stop and most:
        q = chain[p]
        if q < 0:
            break
        add(p)
        p = q
        most -= 1
    return p


def _literals(r: Reader, codes: list[Code], most: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The pixels up to the next back-reference, at most `most`, as _pixels_at() gives them."""
    out = []
    while most:
        if r.window is None or r.window[0] is not codes or not 0 <= r.at - 8 * r.window[1] < len(r.window[2]):
            lo = r.at >> 3
            nxt, rows, step = _steps(r.raw[lo : lo + WINDOW // 8 + 32], codes)
            r.window = codes, lo, nxt, memoryview(_strides(nxt)), rows, step
        _, lo, nxt, far, rows, step = r.window
        if not len(nxt):
            break
        p, stop = r.at - 8 * lo, min(len(nxt), r.end - 8 * lo + 1)
        if all(s is None for s in step):  # no bits at all: one pixel, repeated
            n = most if nxt[0] >= 0 else 0
            at = np.full(n, p, np.int64)
        else:
            first, weight = [], []
            p, n = _follow_far(memoryview(nxt), far, p, stop, most, first, weight)
            at = _all_positions(nxt, first, weight)
        ended = p < stop or n == most
        out.append(_pixels_at(at, codes, rows, step))
        r.at = 8 * lo + p
        most -= n
        if ended:
            break
        if not n:
            raise WebpError("data ends early")
    if not out:
        return np.zeros(0, np.uint32), None
    return np.concatenate([px for px, _ in out]), None if out[0][1] is None else np.concatenate([place for _, place in out])


def _copy(r: Reader, symbol: int, distances: Code, width: int, out: np.ndarray, at: int) -> int:
    """Read a back-reference whose length has this symbol, copy its pixels to out from at on, and return their number."""
    length = r.value(symbol - 256)
    distance = r.value(r.symbol(distances))
    if distance > 120:
        distance -= 120
    else:
        x, y = NEAR[distance - 1]
        distance = max(1, x + y * width)
    if distance > at or length > len(out) - at:
        raise WebpError("back-reference leaves the image")
    part = out[at - distance : at]
    out[at : at + length] = part[:length] if length <= distance else np.resize(part, length)
    return length


def _image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers (height, width)."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise WebpError("colour cache is too large")
    groups, meta, meta_bits = 1, None, 0
    if main and r.read(1):
        meta_bits = r.read(3) + 2
        meta = _image(r, -(-width // (1 << meta_bits)), -(-height // (1 << meta_bits)), False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    sets = [[r.code(n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    total, at = width * height, 0
    out = np.zeros(total, np.uint32)
    cache, cached = np.zeros(1 << cache_bits, np.uint32), 0

    def keep() -> None:
        nonlocal cached
        if cached < at:
            new = out[cached:at]
            cache[_places(new, cache_bits)] = new  # of equal places the last stays
            cached = at

    while at < total:
        if meta is None:
            codes, run = sets[0], total - at
        else:  # the codes hold up to the end of the block's row
            y, x = divmod(at, width)
            codes = sets[int(meta[y >> meta_bits, x >> meta_bits])]
            run = min(((x >> meta_bits) + 1 << meta_bits), width) - x
        px, place = _literals(r, codes, run)
        if place is not None and (place >= 0).any():
            keep()
            px = _recall(px, place, cache_bits, cache=cache)
            cached += len(px)
        out[at : at + len(px)] = px
        at += len(px)
        if len(px) == run:
            continue
        s = r.symbol(codes[0])
        if s < 256:  # a literal at the very end of the data
            red, blue, alpha = (r.symbol(c) for c in codes[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            at += _copy(r, s, codes[4], width, out, at)
        else:
            keep()
            out[at] = cache[s - 280]
            at += 1
    return out.reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    """ARGB numbers as int16 (..., 4): alpha, red, green, blue."""
    return np.stack([argb >> 24, argb >> 16 & 255, argb >> 8 & 255, argb & 255], axis=-1).astype(np.int16)


def _join(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, corner, right, axis: int = -1) -> np.ndarray:
    """What a predictor mode expects from the neighbours: left, top, top-left, top-right (int16, channels along the axis)."""
    half = lambda a, b: a + b >> 1
    toward_zero = lambda d: d + (d < 0) >> 1  # noqa: E731  half of d
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0], np.int16)
    if mode == 11:
        toward_left = np.abs(top - corner).sum(axis=axis, keepdims=True, dtype=np.int16)
        toward_top = np.abs(left - corner).sum(axis=axis, keepdims=True, dtype=np.int16)
        return np.where(toward_left < toward_top, left, top)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: half(half(left, right), top), 6: lambda: half(left, corner), 7: lambda: half(left, top), 8: lambda: half(corner, top), 9: lambda: half(top, right),
        10: lambda: half(half(left, corner), half(top, right)), 12: lambda: np.clip(left + top - corner, 0, 255),
        13: lambda: np.clip(half(left, top) + toward_zero(half(left, top) - corner), 0, 255),
    }[mode]()


_NO_LEFT = frozenset({0, 2, 3, 4, 8, 9, 14, 15})


def _unpredict(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = argb.shape
    c = _channels(argb)
    c[0, 0] = c[0, 0] + (255, 0, 0, 0) & 255
    c[0, 1:] = np.cumsum(np.concatenate([c[0, :1], c[0, 1:]]).astype(np.int64), axis=0)[1:] & 255
    for y in range(1, h):
        row, above = c[y], c[y - 1]
        row[0] = row[0] + above[0] & 255
        right_end = row[0].copy()  # the pixel after the row above's end is this row's first
        for bx in range(modes.shape[1]):
            mode, x0, x1 = int(modes[y >> bits, bx]) & 15, max(1, bx << bits), min(w, bx + 1 << bits)
            if x0 >= x1:
                continue
            nxt = np.concatenate([above[x0 + 1 : x1 + 1], right_end[None]])[: x1 - x0] if x1 >= w else above[x0 + 1 : x1 + 1]
            if mode in _NO_LEFT:
                row[x0:x1] = row[x0:x1] + predict(mode, None, above[x0:x1], above[x0 - 1 : x1 - 1], nxt) & 255
            elif mode == 1:
                row[x0:x1] = np.cumsum(row[x0 - 1 : x1].astype(np.int64), axis=0)[1:] & 255
            else:
                for x in range(x0, x1):
                    row[x] = row[x] + predict(mode, row[x - 1], above[x], above[x - 1], nxt[x - x0]) & 255
    return _join(c)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int16)


def _blocks(a: np.ndarray, bits: int, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(a, 1 << bits, axis=0), 1 << bits, axis=1)[: shape[0], : shape[1]]


def _uncross(argb: np.ndarray, factors: np.ndarray, bits: int, sign: int = 1) -> np.ndarray:
    f, c = _channels(_blocks(factors, bits, argb.shape)), _channels(argb)
    green, red = _signed(c[..., 2]), c[..., 1].copy()
    c[..., 1] = red + sign * (_signed(f[..., 3]) * green >> 5) & 255
    known = c[..., 1] if sign > 0 else red
    c[..., 3] = c[..., 3] + sign * ((_signed(f[..., 2]) * green >> 5) + (_signed(f[..., 1]) * _signed(known) >> 5)) & 255
    return _join(c)


def _shift_green(argb: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(argb)
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return _join(c)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4), red green blue alpha, of a lossless WebP file."""
    return _decoded(_body(data))


def _decoded(body: bytes) -> np.ndarray:
    r = Reader(body)
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise WebpError("unknown version")
    undo, w = [], width
    while r.read(1):
        kind = r.read(2)
        if any(k == kind for k, *_ in undo):
            raise WebpError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            undo.append((kind, _image(r, -(-w // (1 << bits)), -(-height // (1 << bits)), False), bits, w))
        elif kind == PALETTE:
            n = r.read(8) + 1
            colours = _join(np.cumsum(_channels(_image(r, n, 1, False))[0].astype(np.int64), axis=0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, colours, pack, w))
            w = -(-w // (1 << pack))
        else:
            undo.append((kind, None, 0, w))
    argb = _image(r, w, height, True)
    for kind, what, bits, w in reversed(undo):
        if kind == PREDICTOR:
            argb = _unpredict(argb, what >> 8 & 255, bits)
        elif kind == CROSS_COLOUR:
            argb = _uncross(argb, what, bits)
        elif kind == SUBTRACT_GREEN:
            argb = _shift_green(argb, 1)
        else:
            index = argb >> 8 & 255
            if bits:
                per = 8 >> bits
                index = (index[:, :, None] >> np.arange(1 << bits, dtype=np.uint32) * per & (1 << per) - 1).reshape(height, -1)[:, :w]
            argb = np.concatenate([what, np.zeros(256, np.uint32)])[index]
    return _as_pixels(argb.reshape(height, width))


def _as_pixels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)[..., [2, 1, 0, 3]]


def _body(data: bytes) -> bytes:
    """The bits of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or data[20:21] != b"\x2f":
        raise WebpError("not a lossless WebP file")
    return data[21 : 20 + struct.unpack_from("<I", data, 16)[0]]


class _Opening:
    """What follows the sides in files without transforms and meta codes: its bits, the codes and the bits of the colour cache."""

    def __init__(self, body: bytes):
        r = Reader(body)
        r.at = SIDE_BITS + 5  # alpha flag, version, no transform
        self.cache_bits = r.read(4) if r.read(1) else 0
        r.read(1)  # no meta codes
        self.codes = [r.code(n) for n in (256 + 24 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)]
        self.end, self.n_bytes = r.at, -(-r.at // 8)
        self.bits = self.of(body)

    def of(self, body: bytes) -> int:
        return int.from_bytes(body[: self.n_bytes], "little") >> SIDE_BITS & (1 << self.end - SIDE_BITS) - 1


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """decode() of each file. Files without transforms that begin with the same codes are decoded side by side."""
    out: list[np.ndarray | None] = [None] * len(files)
    openings: list[_Opening] = []
    groups: list[list[tuple[int, bytes]]] = []
    for i, data in enumerate(files):
        body = _body(data)
        begin = int.from_bytes(body[3:5], "little") >> SIDE_BITS - 24
        cached = begin >> 5 & 1
        if len(body) > WINDOW // 8 or len(body) < 5 or begin & 0x1E or begin >> (10 if cached else 6) & 1 or cached and not 0 < begin >> 6 & 15 < 12:
            out[i] = decode(data)
            continue
        k = next((k for k, o in enumerate(openings) if o.of(body) == o.bits), None)
        if k is None:
            k = len(openings)
            openings.append(_Opening(body))
            groups.append([])
        groups[k].append((i, body))
        if sum(len(b) for _, b in groups[k]) >= WINDOW // 8:
            _side_by_side(groups[k], openings[k], out)
            groups[k] = []
        if len(openings) > KEPT_OPENINGS:  # the first ones are those that many files share
            _side_by_side(groups.pop(), openings.pop(), out)
    for opening, group in zip(openings, groups, strict=True):
        _side_by_side(group, opening, out)
    return out


def _side_by_side(group: list[tuple[int, bytes]], opening: _Opening, out: list[np.ndarray | None]) -> None:
    """Decode bodies that share their codes: the steps of all bit positions at once, then each file's own chain."""
    if not group:
        return
    codes = opening.codes
    gap = b"\0" * 8
    raw = np.frombuffer(gap.join(b for _, b in group) + b"\0" * 32, np.uint8)
    nxt, rows, step = _steps(raw, codes)
    free = all(s is None for s in step)
    chain, far, at, weight, begins, plans, lo, n_at = memoryview(nxt), memoryview(_strides(nxt)), [], [], [], [], 0, 0
    for i, body in group:
        r = Reader(body)
        width, height = r.read(14) + 1, r.read(14) + 1
        argb, done, stop = np.empty(width * height, np.uint32), 0, 8 * (lo + len(body))
        r.at, parts = opening.end, []
        begins.append(n_at)
        while done < len(argb):
            p = 8 * lo + r.at
            if free and nxt[0] >= 0:
                n = len(argb) - done
                at += [p] * n
                weight += [1] * n
            else:
                p, n = _follow_far(chain, far, p, stop, len(argb) - done, at, weight)
            parts.append((done, n_at, n_at + n))
            done += n
            n_at += n
            r.at = p - 8 * lo
            if r.at > r.end:
                raise WebpError("data ends early")
            if done < len(argb):
                symbol, begin = r.symbol(codes[0]), r.at
                length = r.value(symbol - 256) if 256 <= symbol < 280 else 0
                if not length:  # a pixel without bits at the very end, or damage
                    parts = None
                    out[i] = _decoded(body)
                    break
                r.value(r.symbol(codes[4]))
                parts.append((done, symbol, begin, length))
                done += length
        if parts is not None:
            plans.append((i, r, argb.reshape(height, width), parts))
        lo += len(body) + len(gap)
    literals, place = _pixels_at(_all_positions(nxt, at, weight), codes, rows, step)
    pixels, late, bits = literals, None, opening.cache_bits
    if place is not None:
        image = np.repeat(np.arange(len(begins)), np.diff(np.array([*begins, n_at])))
        pixels = _recall(literals, place, bits, image)
        late = np.append(np.cumsum(place >= 0), 0)
    for i, r, argb, parts in plans:
        flat = argb.ravel()
        first = next((k for k, part in enumerate(parts) if len(part) == 4), len(parts))
        # what a back-reference copies goes to the cache too: where places follow it, the image is taken part by part
        ordered = late is not None and any(len(part) == 3 and part[2] > part[1] and late[part[2] - 1] > late[part[1] - 1] for part in parts[first:])
        cache = np.zeros(1 << bits, np.uint32) if ordered else None
        for part in parts:
            if len(part) == 3:
                done, a, b = part
                flat[done : done + b - a] = _recall(literals[a:b], place[a:b], bits, cache=cache) if ordered else pixels[a:b]
            else:
                r.at = part[2]
                n = _copy(r, part[1], codes[4], argb.shape[1], flat, part[0])
                if ordered:
                    new = flat[part[0] : part[0] + n]
                    cache[_places(new, bits)] = new
        out[i] = _as_pixels(argb)


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Huffman code lengths of at most `limit`; counts are flattened until they fit."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        out[used] = 1
        return out
    used = [used[i] for i in np.argsort(counts[used], kind="stable").tolist()]
    c, n = counts[used].tolist(), len(used)
    while True:
        weight, parent, leaf, node = c[:], [0] * (2 * n - 1), 0, n
        for k in range(n, 2 * n - 1):
            both = 0
            for _ in (0, 1):  # the lighter of the next leaf and the next node, twice
                if leaf < n and (node >= k or weight[leaf] <= weight[node]):
                    both += weight[leaf]
                    parent[leaf] = k
                    leaf += 1
                else:
                    both += weight[node]
                    parent[node] = k
                    node += 1
            weight.append(both)
        deep = parent
        deep[-1] = 0
        for k in range(2 * n - 3, -1, -1):
            deep[k] = deep[deep[k]] + 1
        if max(deep[:n]) <= limit:
            out[used] = deep[:n]
            return out
        c = [(x + 1) // 2 for x in c]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The stream's bits of every symbol."""
    out, used = np.zeros(len(lengths), np.uint64), np.flatnonzero(lengths)
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        share = 1 << (MAX_BITS - lengths[order])
        out[order] = _REVERSED[np.cumsum(share) - share]
    return out


def _put_code(w: Writer, lengths: np.ndarray, written: dict[tuple, tuple[int, int]]) -> None:
    """Write a code; `written` has the bits of those written before."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1 | len(used) - 1 << 1 | 1 << 2, 3)
        for s in used:
            w.put(s, 8)
        return
    key = tuple(lengths[: used[-1] + 1].tolist())
    if key not in written:
        written[key] = _code_bits(key)
    w.put(*written[key])


def _code_bits(all_: tuple[int, ...]) -> tuple[int, int]:
    tokens, edge = [], [*np.flatnonzero(np.diff(all_)).tolist(), len(all_) - 1]
    for i, end in zip([0, *(e + 1 for e in edge)], edge, strict=False):
        length, n = all_[i], end + 1 - i
        if length:
            tokens.append((length, 0, 0))
            n -= 1
        while n >= 3:
            k = min(n, 6 if length else 138)
            tokens.append((16, k - 3, 2) if length else (18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
            n -= k
        tokens += [(length, 0, 0)] * n
    symbol, extra, more = np.array(tokens, np.int64).T
    first = code_lengths(np.bincount(symbol, minlength=19), 7)
    w = Writer()
    w.put(15 << 1, 5)
    for s in LENGTH_ORDER:
        w.put(int(first[s]), 3)
    n = max(2, (len(tokens) - 2).bit_length() + 1 & ~1)
    w.put(1 | (n - 2) // 2 << 1 | len(tokens) - 2 << 4, 4 + n)
    own = first[symbol] if np.count_nonzero(first) > 1 else np.zeros(len(tokens), np.int64)
    used = own + more
    start = np.cumsum(used) - used
    total = int(used.sum())
    w.put(int.from_bytes(_joined_bits(codes_of(first)[symbol] | extra.astype(np.uint64) << own.astype(np.uint64), start, used, -(-total // 8)), "little"), total)
    return w.value, w.n


def _prefix_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distance codes v."""
    d = v - 1
    top = np.frexp(np.maximum(d, 1).astype(float))[1] - 1
    extra = np.where(d < 4, 0, top - 1)
    return np.where(d < 4, d, 2 * top + (d >> np.maximum(top - 1, 0) & 1)), np.where(d < 4, 0, d - (2 + (d >> np.maximum(top - 1, 0) & 1) << extra)), extra


def _repeats(px: np.ndarray, size: np.ndarray, first: np.ndarray, width: np.ndarray, least: int = 4) -> list[tuple[int, int, int]]:
    """(from, to, distance code) of runs that repeat the pixel on the left (code 2) or above (code 1); px holds images of these sizes one after another."""
    out: list[tuple[int, int, int]] = []
    pos = np.arange(len(px)) - np.repeat(first, size)
    gaps = int(width[0]) if (width == width[0]).all() else np.repeat(width, size)
    for code, gap in ((2, 1), (1, gaps)):
        if isinstance(gap, int):
            same = np.zeros(len(px) + 1, bool)
            same[gap:-1] = px[gap:] == px[: len(px) - gap] if gap < len(px) else False
        else:
            same = np.append(px == px[np.maximum(np.arange(len(px)) - gap, 0)], False)
        same[:-1] &= pos >= gap
        edge = np.flatnonzero(np.diff(same.view(np.int8), prepend=0))
        a, b = edge[::2], edge[1::2]
        long = b - a >= least
        out += zip(a[long].tolist(), b[long].tolist(), [code] * int(long.sum()), strict=True)
    return out


def _chosen(repeats: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """(from, length, distance code) of runs that do not overlap."""
    chosen, at = [], 0
    for a, b, code in sorted(repeats):
        a = max(a, at)
        while b - a >= least:
            n = min(b - a, MAX_COPY)
            chosen.append((a, n, code))
            a = at = a + n
    return chosen


def _copies(px: np.ndarray, width: int, least: int) -> list[tuple[int, int, int]]:
    return _chosen(_repeats(px, np.array([len(px)]), np.zeros(1, np.int64), np.array([width]), least), least)


def _hits(px: np.ndarray, bits: int, image: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pixels (ARGB numbers) in a colour cache, and which of them it holds already; image: ascending numbers of several images."""
    place = _places(px, bits)
    order = _by_place(place, image)
    same = px[order[1:]] == px[order[:-1]]
    if image is not None:
        same &= image[order[1:]] == image[order[:-1]]
    hit = np.zeros(len(px), bool)
    hit[order[1:]] = same
    return place.astype(np.int64), hit


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of each row's symbols by a code of their own."""
    if counts.ndim == 1:
        counts = counts[counts > 0]
    n = counts.sum(axis=-1)
    return n * np.log2(np.maximum(n, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=-1)


def _bits_with_code(counts: np.ndarray, times: int = 1) -> np.ndarray:
    """About what each row's symbols take, and the code for them, which is written so many times."""
    used = counts > 0
    return _entropy(counts) + times * (CODE_BITS + SYMBOL_BITS * used.sum(axis=-1) + GAP_BITS * (used[..., 1:] > used[..., :-1]).sum(axis=-1))


def _cache_bits(px: np.ndarray, literal: np.ndarray) -> int:
    """The size of the colour cache with which these literals take least, about."""
    lit = px[literal]
    green, red, blue = ((lit >> k & 255).astype(np.int64) for k in (8, 16, 0))
    counts = [np.bincount(c, minlength=256) for c in (green, red, blue)]
    best, bits = _bits_with_code(sum(counts), 3), 0
    for b in range(1, 12):
        if not len(px) <= CACHE_SHARE << b <= CACHE_SHARE * max(len(px), 4):
            continue
        place, hit = _hits(px, b)
        place, hit = place[literal], hit[literal]
        rest = ~hit
        symbols = np.bincount(np.where(hit, 256 + place, green), minlength=256)
        took = sum(map(_bits_with_code, (symbols, np.bincount(red[rest], minlength=256), np.bincount(blue[rest], minlength=256))))
        if took < best:
            best, bits = took, b
    return bits


def _put_image(w: Writer, argb: np.ndarray, main: bool, cache_bits: int | None = 0, copies: bool = True) -> bytes | None:
    """Write an entropy-coded image; the main image returns its packed pixel data, which follow the header. cache_bits: None chooses."""
    width, px = argb.shape[1], argb.ravel()
    runs = _copies(px, width, 4) if copies else []
    literal = np.ones(len(px), bool)
    for a, n, _ in runs:
        literal[a : a + n] = False
    at = np.flatnonzero(literal)
    if cache_bits is None:
        cache_bits = _cache_bits(px, literal)
    green = (px[at] >> 8 & 255).astype(np.int64)
    rest = [(px[at] >> s & 255).astype(np.int64) for s in (16, 0, 24)]
    hit = np.zeros(len(at), bool)
    if cache_bits:
        place, hit = _hits(px, cache_bits)
        hit = hit[at]
        green[hit] = 280 + place[at][hit]
    size = 280 + (1 << cache_bits if cache_bits else 0)
    ls, lx, ln = _prefix_of(np.array([n for _, n, _ in runs], np.int64))
    ds = np.array([c - 1 for *_, c in runs], np.int64)
    counts = [np.bincount(np.concatenate([green, 256 + ls]), minlength=size), *(np.bincount(c[~hit], minlength=256) for c in rest), np.bincount(ds, minlength=40)]
    if not cache_bits:  # one code for red, green and blue, whose literals are counted together
        counts[1] = counts[2] = counts[0][:256] + counts[1] + counts[2]
        counts[0] = np.concatenate([counts[1], counts[0][256:]])
    lengths = []
    for i, c in enumerate(counts):
        lengths.append(lengths[1] if i == 2 and not cache_bits else lengths[0][:256] if i == 1 and not cache_bits and not runs else code_lengths(c, ENCODER_BITS))
    w.put(int(bool(cache_bits)), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    written: dict[tuple, tuple[int, int]] = {}
    for n in lengths:
        _put_code(w, n, written)
    lengths = [n if np.count_nonzero(n) > 1 else n * 0 for n in lengths]
    bits = [codes_of(n) for n in lengths]
    value, used = bits[0][green], lengths[0][green]  # a pixel's channels together have 4 * ENCODER_BITS bits at most
    for i, c in enumerate(rest, 1):
        more = lengths[i][c]
        more[hit] = 0
        value |= np.where(hit, np.uint64(0), bits[i][c]) << used.astype(np.uint64)
        used += more
    if runs:
        copied, n = bits[0][256 + ls], lengths[0][256 + ls]
        for v, more in ((lx.astype(np.uint64), ln), (bits[4][ds], lengths[4][ds])):
            copied |= v << n.astype(np.uint64)
            n = n + more
        first = np.argsort(np.concatenate([at, [a for a, *_ in runs]]), kind="stable")
        value, used = np.concatenate([value, copied])[first], np.concatenate([used, n])[first]
    if not main:
        for v, n in zip(value.tolist(), used.tolist(), strict=True):
            w.put(v, n)
        return None
    start = np.cumsum(used) - used + w.n % 64
    total = int(start[-1] + used[-1]) if len(used) else w.n % 64
    words = _joined_bits(value, start, used, -(-total // 8))
    head = w.value >> (w.n // 64 * 64)
    words = (int.from_bytes(words[:8], "little") | head).to_bytes(8, "little")[: len(words)] + words[8:]
    return (w.value & (1 << w.n // 64 * 64) - 1).to_bytes(w.n // 64 * 8, "little") + words


def encode(pixels: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, bits: int = 4, subtract_green: bool = False, palette: bool = True, cache_bits: int | None = None, copies: bool = True) -> bytes:
    """A lossless WebP file of pixels (height, width, 4). predictor: modes by block; cross: ARGB factors by block.

    Without any of these, the transforms are tried and the smallest file is kept; without cache_bits their number is chosen.
    """
    h, width = pixels.shape[:2]
    if not (0 < h <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise WebpError("sides must be from 1 to 16384")
    if predictor is None and cross is None and not subtract_green and cache_bits is None:
        rgb = pixels[..., :3]
        return _smallest(pixels, int(np.argmin(_trials(rgb.reshape(-1, 3), [rgb.shape[:2]])[:, 0])), palette, copies)
    return _written(pixels, predictor, cross, bits, subtract_green, palette, cache_bits, copies)


def _smallest(pixels: np.ndarray, form: int, palette: bool = True, copies: bool = True) -> bytes:
    """The smallest file of those with the palette, where it serves, without transforms, and, where the trial chose one, with each transform and all of them together."""
    files = [_written(pixels, copies=copies)]
    if palette and _indexed(pixels) is not None:
        files.append(_written(pixels, palette=True, copies=copies))
    if form != PLAIN:
        h, w = pixels.shape[:2]
        for off, crossed, predicted in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1)):
            argb = _argb(pixels)
            argb = _shift_green(argb, -1) if off else argb
            cross = _factors(_rgb(argb), np.array([h])) if crossed else None
            argb = _uncross(argb, cross, BLOCK_BITS, -1) if crossed else argb
            modes = _modes(_rgb(argb), np.array([h]))[0] if predicted else None
            files.append(_written(pixels, modes, cross, BLOCK_BITS, bool(off), False, None, copies))
    return min(files, key=len)


def _argb(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels[..., [2, 1, 0, 3]]).view("<u4")[..., 0]


def _rgb(argb: np.ndarray) -> np.ndarray:
    return _channels(argb)[..., 1:].astype(np.uint8)


def _indexed(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Colours and each pixel's among them, where they are few."""
    argb = _argb(pixels)
    colours, index = np.unique(argb, return_inverse=True)
    return (colours, index.reshape(argb.shape)) if len(colours) <= 256 and 4 * len(colours) < argb.size else None


def _written(pixels: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, bits: int = 4, subtract_green: bool = False, palette: bool = False, cache_bits: int | None = None, copies: bool = True) -> bytes:
    """encode() with just these transforms."""
    h, width = pixels.shape[:2]
    argb = _argb(pixels)
    w = Writer()
    w.put(width - 1, 14)
    w.put(h - 1, 14)
    w.put(int(bool((pixels[..., 3] != 255).any())), 1)
    w.put(0, 3)
    if palette and (few := _indexed(pixels)) is not None:
        colours, index = few
        w.put(1 | PALETTE << 1, 3)
        w.put(len(colours) - 1, 8)
        _put_image(w, _join(np.diff(_channels(colours), axis=0, prepend=0))[None, :], False, copies=False)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        index = np.pad(index, ((0, 0), (0, -width % (1 << pack))))
        index = (index.reshape(h, -1, 1 << pack) << np.arange(1 << pack) * (8 >> pack)).sum(axis=2)
        argb = (index.astype(np.uint32) << 8) | np.uint32(0xFF000000)
    if subtract_green:
        w.put(1 | SUBTRACT_GREEN << 1, 3)
        argb = _shift_green(argb, -1)
    if cross is not None:
        w.put(1 | CROSS_COLOUR << 1, 3)
        w.put(bits - 2, 3)
        _put_image(w, cross, False, copies=False)
        argb = _uncross(argb, cross, bits, -1)
    if predictor is not None:
        w.put(1 | PREDICTOR << 1, 3)
        w.put(bits - 2, 3)
        _put_image(w, predictor.astype(np.uint32) << 8 | np.uint32(0xFF000000), False, copies=False)
        argb = _residual(argb, predictor, bits)
    w.put(0, 1)
    body = b"\x2f" + _put_image(w, argb, True, cache_bits, copies)
    return _file(body)


def _block_rows(height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of images one below another: the row of blocks of each row of pixels, and where each row of blocks begins."""
    n = -(-height // (1 << BLOCK_BITS))
    y = np.arange(height.sum()) - np.repeat(np.cumsum(height) - height, height)
    row = np.repeat(np.cumsum(n) - n, height) + (y >> BLOCK_BITS)
    return row, np.flatnonzero(np.diff(row, prepend=-1))


def _block_sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of (rows, width) by block."""
    return np.add.reduceat(np.add.reduceat(x, begin, axis=0, dtype=x.dtype if x.itemsize > 2 else np.int32), np.arange(0, x.shape[1], 1 << BLOCK_BITS), axis=1, dtype=np.int64)


def _spread(blocks: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    return np.repeat(blocks[row], 1 << BLOCK_BITS, axis=1)[:, :width]


def _modes(rgb: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The predictor mode that leaves least in each block of images (rows, width, 3), one below another, and what remains (channels, rows, width)."""
    width = rgb.shape[1]
    row, begin = _block_rows(height)
    flat = np.ascontiguousarray(rgb.reshape(-1, 3).T).astype(np.int16)
    left, top, corner, right = (np.roll(flat, k, axis=1) for k in (1, width, width + 1, width - 1))
    rest, cost, first = [], [], np.cumsum(height) - height
    for mode in range(14):
        r = (flat - predict(mode, left, top, corner, right, 0) if mode else flat).astype(np.uint8)
        rest.append(r.reshape(3, -1, width))
        left_over = np.minimum(r, -r).sum(axis=0, dtype=np.uint16).reshape(-1, width)
        left_over[first], left_over[:, 0] = 0, 0  # these have modes of their own
        cost.append(_block_sums(left_over, begin))
    modes = np.argmin(cost, axis=0)
    chosen, out = _spread(modes, row, width), np.empty_like(rest[0])
    for mode in np.unique(modes).tolist():
        np.copyto(out, rest[mode], where=chosen == mode)
    out[..., 0] = rest[2][..., 0]
    out[:, first] = rest[1][:, first]
    out[:, first, 0] = rest[0][:, first, 0]
    return modes, out


def _factors(rgb: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Cross-colour factors (ARGB numbers) that fit red and blue to green best in each block."""
    _, begin = _block_rows(height)
    red, green, blue = (x.astype(np.int64) for x in np.moveaxis(rgb.view(np.int8), 2, 0))
    own = np.maximum(_block_sums(green * green, begin), 1)
    fit = [np.clip(np.rint(32 * _block_sums(green * x, begin) / own), -128, 127).astype(np.int64) & 255 for x in (red, blue)]
    return (0xFF000000 | fit[1] << 8 | fit[0]).astype(np.uint32)


def _trials(rgb: np.ndarray, sides: list[tuple[int, int]]) -> np.ndarray:
    """About how many bits each image takes by own codes: a row for each form. rgb holds the pixels of all images one after another.

    A long image is counted in pieces of TRIAL_ROWS rows or, where they are wide, less, which bounds the memory.
    """
    out, at, portion, held = np.zeros((4, len(sides))), 0, [], 0
    counted: list[np.ndarray] | None = None
    for i, (h, w) in enumerate(sides):
        rows = max(1 << BLOCK_BITS, TRIAL_ROWS * 64 // w >> BLOCK_BITS << BLOCK_BITS)
        if h > rows:
            for y in range(0, h, rows):
                n = min(rows, h - y)
                part = _counted(rgb[at + y * w : at + (y + n) * w], [n], w)
                counted = part if counted is None else [x + p for x, p in zip(counted, part, strict=True)]
            out[:, i], counted = _trial_bits(counted)[:, 0], None
        else:
            portion.append((w, i, at, h))
            held += h * w
        at += h * w
        if portion and (held >= TRIAL_ROWS * 64 or i + 1 == len(sides)):
            for w in {x[0] for x in portion}:
                those = [x for x in portion if x[0] == w]
                px = rgb[those[0][2] : those[-1][2] + those[-1][3] * w]
                if len(px) != sum(x[3] for x in those) * w:  # images of other widths lie between them
                    px = np.concatenate([rgb[a : a + h * w] for _, _, a, h in those])
                out[:, [x[1] for x in those]] = _trial_bits(_counted(px, [x[3] for x in those], w))
            portion, held = [], 0
    return out


def _counted(px: np.ndarray, heights: list[int], width: int) -> list[np.ndarray]:
    """What each form counts in images of one width (pixels one after another): plain bytes, green with places of the cache, red and blue beside it, bytes of the three transforms, and blocks."""
    h, rows = np.array(heights, np.int64), px.reshape(-1, width, 3)
    own = np.repeat(np.arange(len(h)), h * width)
    row, _ = _block_rows(h)
    red, green, blue = plain = np.ascontiguousarray(px.T)
    base = own << 8
    counts = lambda x: np.bincount((base | x.reshape(3, -1)).ravel(), minlength=len(h) << 8).reshape(-1, 256)
    place, hit = _hits(np.uint32(0xFF) << 24 | red.astype(np.uint32) << 16 | green.astype(np.uint32) << 8 | blue, TRIAL_CACHE, own)
    n, literal = 256 + (1 << TRIAL_CACHE), ~hit
    symbols = np.bincount(own * n + np.where(hit, 256 + place, green), minlength=len(h) * n).reshape(len(h), n)
    rest = [np.bincount(base[literal] | x[literal], minlength=len(h) << 8).reshape(-1, 256) for x in (red, blue)]
    f = _spread(_factors(rows, h), row, width).ravel()
    turn = lambda k: ((f >> k & 255).astype(np.uint8).view(np.int8) * green.view(np.int8).astype(np.int16) >> 5).astype(np.uint8)
    blocks = -(-h // (1 << BLOCK_BITS)) * -(-width // (1 << BLOCK_BITS))
    return [counts(plain), symbols, *rest, counts(np.stack([red - green, green, blue - green])), counts(np.stack([red - turn(0), green, blue - turn(8)])), counts(_modes(rows, h)[1]), blocks]


def _trial_bits(counted: list[np.ndarray]) -> np.ndarray:
    """Bits by form of what _counted() gives."""
    plain, symbols, red, blue, less, crossed, predicted, blocks = counted
    bits = lambda x: _bits_with_code(x, 3)
    return np.stack([np.minimum(bits(plain), sum(map(_bits_with_code, (symbols, red, blue)))), bits(less), bits(crossed) + 16 * blocks, bits(predicted) + 4 * blocks])


def _file(body: bytes) -> bytes:
    size = len(body)
    return b"RIFF" + struct.pack("<I", 12 + size + (size & 1)) + b"WEBPVP8L" + struct.pack("<I", size) + body + b"\0" * (size & 1)


class Shared:
    """Codes that many images of bytes alike can share: one for green, lengths and the colour cache, one for red and blue."""

    def __init__(self, bytes_seen: np.ndarray, copies: int = 0, cached: np.ndarray | None = None):
        """bytes_seen: how often each byte occurs in literals; copies: about how many runs repeat a neighbour; cached: how often each place of the colour cache is met (None: there is none)."""
        seen = np.array(bytes_seen, np.int64)
        seen[[0, 32]] = np.maximum(seen[[0, 32]], 1)  # a code has two symbols at least; an image with bytes that have none has its own
        self.cache_bits = 0 if cached is None else (len(cached) - 1).bit_length()
        counts = np.concatenate([seen if cached is None else -(-seen // 3), np.full(24, copies // 24 + 1), np.zeros(0, np.int64) if cached is None else np.asarray(cached, np.int64) + 1])
        self.green, self.rest = code_lengths(counts, ENCODER_BITS), code_lengths(seen, ENCODER_BITS)
        self.green_bits, self.rest_bits = codes_of(self.green), codes_of(self.rest)
        w, written = Writer(), {}
        w.put(0, 5)  # opaque, version, no transform
        w.put(1 | self.cache_bits << 1 if self.cache_bits else 0, 5 if self.cache_bits else 1)
        w.put(0, 1)  # no meta codes
        opaque, near = np.zeros(256, np.int64), np.zeros(40, np.int64)
        opaque[255], near[:2] = 1, 1
        for lengths in (self.green, self.rest, self.rest, opaque, near):
            _put_code(w, lengths, written)
        self.head = [(w.value >> i & (1 << 48) - 1, min(48, w.n - i)) for i in range(0, w.n, 48)]
        self.head_bits = SIDE_BITS + w.n


def _flat(images: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """The pixels of images (height, width, 3) one after another, their sides, the image of each pixel, and the pixels as numbers."""
    sides = [p.shape[:2] for p in images]
    rgb = np.concatenate([p.reshape(-1, 3) for p in images])
    px = np.uint32(0xFF) << 24 | rgb[:, 0].astype(np.uint32) << 16 | rgb[:, 1].astype(np.uint32) << 8 | rgb[:, 2]
    return rgb, sides, np.repeat(np.arange(len(images)), [h * w for h, w in sides]), px


def _runs(px: np.ndarray, sides: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(from, length, distance code) of the runs that repeat a neighbour, and which pixels are in none."""
    height, width = np.array(sides, np.int64).T
    size = height * width
    runs = np.array(_chosen(_repeats(px, size, np.cumsum(size) - size, width), 4), np.int64).reshape(-1, 3)
    edge = np.zeros(len(px) + 1, np.int8)
    edge[runs[:, 0]] += 1
    np.subtract.at(edge, runs[:, 0] + runs[:, 1], 1)
    return runs, np.cumsum(edge[:-1], dtype=np.int8) == 0


def symbols_of(images: list[np.ndarray], cache_bits: int = SHARED_CACHE) -> tuple[np.ndarray, int, np.ndarray]:
    """What Shared is made of: bytes of literals, number of runs and places of the colour cache in opaque images (height, width, 3)."""
    rgb, sides, own, px = _flat(images)
    runs, literal = _runs(px, sides)
    place, hit = _hits(px, cache_bits, own)
    return np.bincount(rgb[literal & ~hit].ravel(), minlength=256), len(runs), np.bincount(place[literal & hit], minlength=1 << cache_bits)


def encode_many(images: list[np.ndarray], shared: Shared) -> list[bytes]:
    """Lossless WebP files of opaque images (height, width, 3): by the shared codes, side by side, or by own codes, with a transform or without, where these serve better."""
    rgb, sides, own, px = _flat(images)
    height, width = np.array(sides, np.int64).T
    if (height > MAX_SIDE).any() or (width > MAX_SIDE).any():
        raise WebpError("sides must be from 1 to 16384")
    runs, literal = _runs(px, sides)
    at = np.flatnonzero(literal)
    red, green, blue = rgb[at].T.astype(np.int64)
    g, r, b = shared.green[green], shared.rest[red], shared.rest[blue]
    value = shared.green_bits[green] | shared.rest_bits[red] << g.astype(np.uint64) | shared.rest_bits[blue] << (g + r).astype(np.uint64)
    used, lacking = g + r + b, (g == 0) | (r == 0) | (b == 0)
    if shared.cache_bits:
        place, hit = _hits(px, shared.cache_bits, own)
        hit = hit[at]
        symbol = 280 + place[at][hit]
        value[hit], used[hit], lacking[hit] = shared.green_bits[symbol], shared.green[symbol], False
    no_code = np.bincount(own[at[lacking]], minlength=len(images)) > 0
    if len(runs):
        symbol, extra, bits = _prefix_of(runs[:, 1])
        lead = shared.green[256 + symbol]
        copied = shared.green_bits[256 + symbol] | extra.astype(np.uint64) << lead.astype(np.uint64) | (runs[:, 2] - 1).astype(np.uint64) << (lead + bits).astype(np.uint64)
        at = np.concatenate([at, runs[:, 0]])
        order = np.argsort(at, kind="stable")
        at, value, used = (x[order] for x in (at, np.concatenate([value, copied]), np.concatenate([used, lead + bits + 1])))
    of = own[at]
    tried = _trials(rgb, sides)
    apart = no_code | (tried.min(axis=0) + OWN_SAVES < np.bincount(of, weights=used, minlength=len(images)) + shared.head_bits)
    out: list[bytes | None] = [None] * len(images)
    together = np.flatnonzero(~apart)
    if len(together):
        if apart.any():
            keep = ~apart[of]
            of, value, used = (np.cumsum(~apart) - 1)[of[keep]], value[keep], used[keep]
        for i, data in zip(together.tolist(), _shared_files(of, value, used, height[together], width[together], shared), strict=True):
            out[i] = data
    del rgb, own, px, literal, at, red, green, blue, g, r, b, value, used, of  # a long image with own codes needs the room
    for i in np.flatnonzero(apart).tolist():
        out[i] = _smallest(np.concatenate([images[i], np.full((*images[i].shape[:2], 1), 255, np.uint8)], axis=2), int(np.argmin(tried[:, i])))
    return out


def _shared_files(own: np.ndarray, value: np.ndarray, used: np.ndarray, height: np.ndarray, width: np.ndarray, shared: Shared) -> list[bytes]:
    """Files by the shared codes; own: the image of each value, in ascending order."""
    heads, n = 1 + len(shared.head), len(height)
    place = np.arange(len(own)) + heads * (own + 1)
    opening = np.searchsorted(own, np.arange(n)) + heads * np.arange(n)
    values, lengths = np.zeros(len(own) + heads * n, np.uint64), np.zeros(len(own) + heads * n, np.int64)
    values[place], lengths[place] = value, used
    values[opening], lengths[opening] = (width - 1 | height - 1 << 14).astype(np.uint64), SIDE_BITS
    for i, (bits, length) in enumerate(shared.head, 1):
        values[opening + i], lengths[opening + i] = bits, length
    start = np.cumsum(lengths) - lengths
    whole = np.diff(np.append(start[opening], lengths.sum()))
    n_bytes = -(-whole // 8)
    base = np.cumsum(n_bytes) - n_bytes
    start += np.repeat(8 * base - start[opening], np.diff(np.append(opening, len(values))))
    raw = _joined_bits(values, start, lengths, int(n_bytes.sum()))
    return [_file(b"\x2f" + raw[a : a + m]) for a, m in zip(base.tolist(), n_bytes.tolist(), strict=True)]


def _joined_bits(value: np.ndarray, start: np.ndarray, used: np.ndarray, n_bytes: int) -> bytes:
    """The bytes in which each value stands at its ascending bit position."""
    words = np.zeros(n_bytes // 8 + 2, np.uint64)
    cell, shift = start >> 6, (start & 63).astype(np.uint64)
    edge = np.flatnonzero(np.diff(cell, prepend=-1))
    words[cell[edge]] = np.bitwise_or.reduceat(value << shift, edge)
    over = np.flatnonzero((start & 63) + used > 64)
    words[cell[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    return words.tobytes()[:n_bytes]


def _residual(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """What remains of the pixels after prediction from their true neighbours."""
    h, w = argb.shape
    c = _channels(argb)
    flat = c.reshape(-1, 4)
    near = [np.roll(flat, k, axis=0) for k in (1, w, w + 1, w - 1)]
    mode = _blocks(modes, bits, (h, w)).ravel()
    expect = np.empty_like(flat)
    for k in np.unique(modes).tolist():
        at = mode == k
        expect[at] = predict(k, *(x[at] for x in near))
    expect = expect.reshape(c.shape)
    expect[1:, 0] = c[:-1, 0]
    expect[0, 1:] = c[0, :-1]
    expect[0, 0] = (255, 0, 0, 0)
    return _join(c - expect)
