"""Lossless WebP: a full decoder of the public bitstream, and an encoder for bytes as grey pixels.

The decoder reads prefix codes (simple and normal, with groups chosen per block), back
references with the distance map, the colour cache, and undoes predictor, cross-colour,
subtract-green and palette transforms.  Streams of one code group that vary in green only
take a quicker walk, references included, to the same pixels.  The encoder tries back
references, a packed palette and a predictor and keeps the shortest file.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the order of code-length codes, and the distance map of near pixels (dx, dy).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


_REVERSED_BITS = sum(((np.arange(1 << 15) >> i & 1) << (14 - i)) for i in range(15))
_REVERSED = _REVERSED_BITS.tolist()


class Bits:
    """Reads a stream from its least significant bit."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.limit = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if self.at + n > self.limit:
            raise ValueError("the stream ends early")
        got = self.peek(n)
        self.at += n
        return got


class Prefix:
    """A canonical prefix code as a table over the next ``width`` bits."""

    def __init__(self, lengths: list[int] | np.ndarray) -> None:
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("an empty prefix code")
        self.only = used[0][1] if len(used) == 1 else None
        self.width = 0 if self.only is not None else max(n for n, _ in used)
        self.symbol, self.length = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.uint8)
        self.is_long = np.zeros(1 << self.width, bool)
        if self.only is not None:
            self.symbol[0] = self.only
            return
        if sum(1 << (self.width - n) for n, _ in used) != 1 << self.width:
            raise ValueError("prefix code lengths that do not fill the tree")
        # Codes rise with their lengths, so each has a run of the table, read with the first bit highest.
        n, s = np.array(sorted(used), np.int64).T
        run = np.repeat(np.arange(len(n)), 1 << (self.width - n))
        at = _REVERSED_BITS[: 1 << self.width] >> (15 - self.width)
        self.symbol[at], self.length[at] = s[run], n[run]
        self.is_long = self.symbol >= 256
        self._s: list[int] = []

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if not self._s:
            self._s, self._n = self.symbol.tolist(), self.length.tolist()
        k = bits.peek(self.width)
        bits.at += self._n[k]
        if bits.at > bits.limit:
            raise ValueError("the stream ends early")
        return self._s[k]


def canonical(lengths: list[int]) -> list[int]:
    """Codes of ascending lengths, each the one before plus one at its own length."""
    codes, code, last = [], 0, 0
    for n in lengths:
        code <<= n - last
        last = n
        codes.append(code)
        code += 1
    return codes


def _read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if bits.take(1):
        two, first = bits.take(1), None
        first = bits.take(8 if bits.take(1) else 1)
        lengths[first] = 1
        if two:
            second = bits.take(8)
            lengths[second] = 1
        return Prefix(lengths)
    sizes = [0] * 19
    for i in range(4 + bits.take(4)):
        sizes[LENGTH_ORDER[i]] = bits.take(3)
    code = Prefix(sizes)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        n = 3 + bits.take(2) if s == 16 else 3 + bits.take(3) if s == 17 else 11 + bits.take(7)
        if at + n > alphabet:
            raise ValueError("code lengths beyond the alphabet")
        if s == 16:
            lengths[at : at + n] = [last] * n
        at += n
    return Prefix(lengths)


def _extra(bits: Bits, symbol: int) -> int:
    """Value of a length or distance prefix, from 1."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.take(n) + 1


def _div(a: int, b: int) -> int:
    return -(-a // b)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels as unsigned 32-bit values in reading order."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache beyond 2**11")
    group_of, scale, groups = None, 0, 1
    if main and bits.take(1):
        scale = bits.take(3) + 2
        meta = _image(bits, _div(width, 1 << scale), _div(height, 1 << scale), False)
        group_of = (meta >> 8 & 0xFFFF).tolist()
        groups = max(group_of) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [tuple(_read_prefix(bits, n) for n in sizes) for _ in range(groups)]
    total = width * height
    if group_of is None and not cache_bits:
        quick = _greens(bits, codes[0], total, width)
        if quick is not None:
            return quick
    out, cache, filled, at = [0] * total, [0] * (1 << cache_bits if cache_bits else 0), 0, 0
    per_row = _div(width, 1 << scale)
    green, red, blue, alpha, far = codes[0]

    def remember(upto: int) -> None:
        nonlocal filled
        while filled < upto:
            cache[(0x1E35A7BD * out[filled] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[filled]
            filled += 1

    while at < total:
        if group_of is not None:
            green, red, blue, alpha, far = codes[group_of[(at // width >> scale) * per_row + (at % width >> scale)]]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n, d = _reference(bits, s, far, width)
            if d > at or at + n > total:
                raise ValueError("a back reference outside the image")
            for i in range(at, at + n):
                out[i] = out[i - d]
            at += n
        else:
            remember(at)
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _greens(bits: Bits, codes: tuple[Prefix, ...], total: int, width: int) -> np.ndarray | None:
    """Pixels of one code group without a cache whose other channels are constant: literals and back references; None for any other."""
    green, red, blue, alpha, far = codes
    if any(c.only is None for c in (red, blue, alpha)) or (green.only is not None and green.only >= 256):
        return None
    base = alpha.only << 24 | red.only << 16 | blue.only
    if green.only is not None:
        return np.full(total, base | green.only << 8, np.uint32)
    # At every bit position: the symbol that would start there, and the bits of its whole token.
    byte = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, offset=byte)
    room = np.concatenate((raw, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(raw) + 8,), "<u8", room.data, 0, (1,))

    def window(at: np.ndarray, n: int) -> np.ndarray:
        return (eight[np.minimum(at >> 3, len(raw))] >> (at & 7).astype(np.uint64) & np.uint64((1 << n) - 1)).astype(np.int64)

    words = np.ndarray((len(raw),), "<u4", room.data, 0, (1,)).astype(np.int64)
    slot = ((words[:, None] >> np.arange(8)) & ((1 << green.width) - 1)).ravel()
    steps = (green.length | green.is_long.astype(np.uint8) << 7)[slot]
    refs = np.flatnonzero(steps > 127)
    if len(refs):
        steps &= 127
        n = _EXTRA[green.symbol[slot[refs]] - 256]
        at = refs + steps[refs] + n
        key = window(at, far.width)
        steps[refs] += (n + far.length[key] + _EXTRA[far.symbol[key]]).astype(np.uint8)
    # Four tokens at once: where the second, then the fourth after each position starts.
    n = len(steps)
    leaps = [np.zeros(n + (1 << 10), np.int64)]
    leaps[0][:n] = steps
    every = np.arange(n)
    for _ in range(2):
        last = leaps[-1]
        leaps.append(last.copy())
        leaps[-1][:n] += last[every + last[:n]]
    jump, at, places = memoryview(leaps.pop()), bits.at & 7, array.array("q")
    append = places.append
    for _ in range((total + 3) >> 2):
        if at >= len(steps):  # the stream's end
            break
        append(at)
        at += jump[at]
    place = np.frombuffer(places, np.int64)
    for last in reversed(leaps):
        place = np.stack((place, place + last[place]), 1).ravel()
    place = place[: np.searchsorted(place, len(steps))]
    symbol = green.symbol[slot[place]]
    ref = np.flatnonzero(symbol >= 256)
    size = np.ones(len(place), np.int64)
    if len(ref):
        first = place[ref] + green.length[slot[place[ref]]]
        kind = symbol[ref] - 256
        size[ref] = _base(kind) + window(first, 24) % (1 << _EXTRA[kind])
        first += _EXTRA[kind]
        kind = far.symbol[window(first, far.width)]
        first += far.length[window(first, far.width)]
        d = _base(kind) + window(first, 24) % (1 << _EXTRA[kind])
    end = np.cumsum(size)
    upto = int(np.searchsorted(end, total))  # tokens up to the last pixel; what follows is padding
    if upto == len(end) or end[upto] != total:
        raise ValueError("the stream ends early" if upto == len(end) else "a back reference outside the image")
    bits.at = 8 * byte + int(place[upto]) + int(steps[place[upto]])
    if bits.at > bits.limit:
        raise ValueError("the stream ends early")
    out = np.zeros(total, np.uint8)
    plain = np.flatnonzero(symbol[: upto + 1] < 256)
    out[end[plain] - 1] = symbol[plain]
    if len(ref):
        some = ref <= upto
        start = (end - size)[ref[some]]
        d = np.where(d[some] > len(NEAR), d[some] - len(NEAR), np.maximum(1, (_NEAR_XY[:, 0] + _NEAR_XY[:, 1] * width)[np.minimum(d[some], len(NEAR)) - 1]))
        if (d > start).any():
            raise ValueError("a back reference outside the image")
        _copy(out, start.tolist(), d.tolist(), size[ref[some]].tolist())
    return out.astype(np.uint32) << 8 | np.uint32(base)


def _copy(out: np.ndarray, start: list[int], back: list[int], size: list[int]) -> None:
    """Carry out references in order; one longer than its distance repeats what it makes."""
    px = memoryview(out)
    for at, d, n in zip(start, back, size, strict=True):
        if n <= d:
            px[at : at + n] = px[at - d : at - d + n]
        else:
            px[at : at + n] = (bytes(px[at - d : at]) * (n // d + 1))[:n]


_NEAR_XY = np.array(NEAR, np.int64)
#: Extra bits of length and distance symbols.
_EXTRA = np.array([0, 0, 0, 0, *[(i - 2) >> 1 for i in range(4, 40)]], np.int64)


def _base(symbol: np.ndarray) -> np.ndarray:
    """Least value of length or distance symbols."""
    symbol = symbol.astype(np.int64)
    return np.where(symbol < 4, symbol, (2 + (symbol & 1)) << _EXTRA[symbol]) + 1


def _reference(bits: Bits, symbol: int, far: Prefix, width: int) -> tuple[int, int]:
    """Length and distance of a back reference in pixels; short distances name a pixel nearby."""
    n, d = _extra(bits, symbol - 256), _extra(bits, far.read(bits))
    if d > len(NEAR):
        return n, d - len(NEAR)
    dx, dy = NEAR[d - 1]
    return n, max(1, dx + dy * width)


def _split(p: np.ndarray) -> np.ndarray:
    """(n, 4) of alpha, red, green, blue."""
    return np.stack([(p >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _merge(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, left: list, top: list, top_left: list, top_right: list) -> list:
    def mean(a: list, b: list) -> list:
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    if mode == 11:
        pl = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        pt = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if pl < pt else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        half = mean(left, top)
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(half, top_left, strict=True)]
    return {
        0: lambda: [255, 0, 0, 0], 1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: mean(mean(left, top_right), top), 6: lambda: mean(left, top_left), 7: lambda: mean(left, top), 8: lambda: mean(top_left, top),
        9: lambda: mean(top, top_right), 10: lambda: mean(mean(left, top_left), mean(top, top_right)),
    }[mode if mode < 14 else 0]()


def _undo_predictor(pixels: np.ndarray, width: int, height: int, scale: int, modes: np.ndarray) -> np.ndarray:
    c = _split(pixels).tolist()
    per_row, kinds = _div(width, 1 << scale), (modes >> 8 & 15).tolist()
    for i in range(width * height):
        x, y = i % width, i // width
        if i == 0:
            p = [255, 0, 0, 0]
        elif y == 0:
            p = c[i - 1]
        elif x == 0:
            p = c[i - width]
        else:  # the pixel right of the row above the last column is the first of this row
            p = _predicted(kinds[(y >> scale) * per_row + (x >> scale)], c[i - 1], c[i - width], c[i - width - 1], c[i - width + 1])
        c[i] = [(a + b) & 255 for a, b in zip(c[i], p, strict=True)]
    return _merge(np.array(c, np.int64).reshape(-1, 4))


def _undo_cross(pixels: np.ndarray, width: int, height: int, scale: int, elements: np.ndarray) -> np.ndarray:
    c, e = _split(pixels), _split(elements)
    y, x = np.divmod(np.arange(width * height), width)
    e = e[(y >> scale) * _div(width, 1 << scale) + (x >> scale)]

    def signed(v: np.ndarray) -> np.ndarray:
        return ((v & 255) ^ 128) - 128

    green = signed(c[:, 2])
    c[:, 1] = (c[:, 1] + (signed(e[:, 3]) * green >> 5)) & 255
    c[:, 3] = (c[:, 3] + (signed(e[:, 2]) * green >> 5) + (signed(e[:, 1]) * signed(c[:, 1]) >> 5)) & 255
    return _merge(c)


def _undo_palette(pixels: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    shift = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    index = (pixels >> 8 & 255).reshape(height, -1)
    if shift:
        each = 8 >> shift
        index = (index[:, :, None] >> (np.arange(1 << shift, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)  # an index beyond the table is transparent black
    full[: len(table)] = table
    return full[index.ravel()]


def _add_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    # Red and blue are added to at once: 16 bits lie between them.
    return (pixels & np.uint32(0xFF00FF00)) | ((pixels & np.uint32(0x00FF00FF)) + green * np.uint32(0x00010001) & np.uint32(0x00FF00FF))


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) bytes red, green, blue, alpha of one lossless file."""
    pixels = decode_argb(data)
    return np.stack([(pixels >> s) & 255 for s in (16, 8, 0, 24)], -1).astype(np.uint8)


def decode_argb(data: bytes) -> np.ndarray:
    """(height, width) ARGB pixels of one lossless file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    bits = Bits(data[20 : 20 + size])
    if bits.take(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("an unknown version")
    undo, now = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind < 2:
            scale = bits.take(3) + 2
            part = _image(bits, _div(now, 1 << scale), _div(height, 1 << scale), False)
            undo.append((lambda p, w=now, s=scale, t=part, f=(_undo_predictor, _undo_cross)[kind]: f(p, w, height, s, t)))
        elif kind == 2:
            undo.append(_add_green)
        else:
            n = bits.take(8) + 1
            table = _merge(np.cumsum(_split(_image(bits, n, 1, False)), 0))
            undo.append(lambda p, w=now, t=table: _undo_palette(p, w, height, t))
            now = _div(now, 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1)
    pixels = _image(bits, now, height, True)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels.reshape(height, width)


def code_lengths(counts: list[int], longest: int = 15) -> list[int]:
    """Lengths of a prefix code for the counts; zero counts get none."""
    used = [i for i, n in enumerate(counts) if n]
    lengths, least = [0] * len(counts), 1
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    while used:
        # Leaves in order and joined pairs in order of making: the two least are at the fronts.
        order = sorted(used, key=lambda i: (max(counts[i], least), i))
        weight, up, leaf, pair = [max(counts[i], least) for i in order], [0] * (2 * len(order) - 1), 0, len(order)
        for made in range(len(order), 2 * len(order) - 1):
            both = 0
            for _ in range(2):
                if pair >= made or (leaf < len(order) and weight[leaf] <= weight[pair]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, pair = pair, pair + 1
                up[k] = made
                both += weight[k]
            weight.append(both)
        depth = [0] * len(up)
        for k in range(len(up) - 2, -1, -1):
            depth[k] = depth[up[k]] + 1
        if depth[0] <= longest:
            for i, n in zip(order, depth, strict=False):
                lengths[i] = n
            return lengths
        least = least * 2 + max(counts) // 65536  # flatter counts until the code is short enough
    return lengths


class BitWriter:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def prefix(self, lengths: list[int]) -> None:
        """A prefix code by its lengths, in the simple form where that exists."""
        used = [i for i, n in enumerate(lengths) if n]
        if not used or (len(used) <= 2 and used[-1] < 256):
            used = used or [0]
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(used[0] > 1, 1)
            self.put(used[0], 8 if used[0] > 1 else 1)
            if len(used) == 2:
                self.put(used[1], 8)
            return
        items = []  # (code-length symbol, extra bits, their number)
        for length, run in itertools.groupby(lengths):
            n = len(list(run))
            if length == 0:
                while n >= 3:
                    k = min(n, 138)
                    items.append((18, k - 11, 7) if k > 10 else (17, k - 3, 3))
                    n -= k
                items += [(0, 0, 0)] * n
            else:
                items.append((length, 0, 0))
                n -= 1
                while n >= 3:
                    k = min(n, 6)
                    items.append((16, k - 3, 2))
                    n -= k
                items += [(length, 0, 0)] * n
        counts = [0] * 19
        for s, _, _ in items:
            counts[s] += 1
        sizes = code_lengths(counts, 7)
        self.put(0, 1)
        last = max(k for k in range(19) if sizes[LENGTH_ORDER[k]])
        self.put(max(4, last + 1) - 4, 4)
        for k in range(max(4, last + 1)):
            self.put(sizes[LENGTH_ORDER[k]], 3)
        self.put(0, 1)
        single = sum(n > 0 for n in sizes) == 1
        code = written_codes(sizes)
        for s, extra, n in items:
            if not single:
                self.put(code[s], sizes[s])
            self.put(extra, n)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def written_codes(lengths: list[int]) -> list[int]:
    """Each symbol's code, first bit lowest."""
    order = sorted((n, s) for s, n in enumerate(lengths) if n)
    out = [0] * len(lengths)
    for (n, s), code in zip(order, canonical([n for n, _ in order]), strict=True):
        out[s] = _REVERSED[code] >> (15 - n)
    return out


def riff(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


#: Bytes that a match shares with an earlier place at least, and pixels of a reference at most.
MATCH, LONGEST = 12, 4096
_NEAR_CODE: dict[int, dict[int, int]] = {}


def _prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their number) of lengths or distances from 1."""
    x = v - 1
    n = np.maximum(0, np.frexp(x.astype(np.float64))[1] - 2)
    big = x >= 4
    return np.where(big, 2 * n + 2 + (x >> n & 1), x), np.where(big, x & ((1 << n) - 1), 0), np.where(big, n, 0)


def matches(px: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, distance, length) of back references, taken greedily from left to right.

    A place matches the last earlier one with the same MATCH bytes, as far as they agree.
    """
    if len(px) < 2 * MATCH:
        return []
    n = len(px) - MATCH + 1
    eight = np.ndarray((len(px) - 7,), "<u8", np.ascontiguousarray(px).data, 0, (1,))
    with np.errstate(over="ignore"):
        key = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[MATCH - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F)
        key = key * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    key.sort()  # by a hash of the bytes, then by place
    again = np.flatnonzero(key[1:] >> np.uint64(32) == key[:-1] >> np.uint64(32))
    if not len(again):
        return []
    order = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    before = np.full(n, -1, np.int64)
    before[order[again + 1]] = order[again]
    places = np.flatnonzero(before >= 0)
    raw, out, i = px.tobytes(), [], 0
    starts = places.tolist()
    far = before[places].tolist()
    while i < len(starts):
        at, src = starts[i], far[i]
        n, most = MATCH, min(LONGEST, len(raw) - at)
        if most < n or raw[at : at + n] != raw[src : src + n]:
            i += 1
            continue
        while n < most:
            step = min(64, most - n)
            if raw[at + n : at + n + step] == raw[src + n : src + n + step]:
                n += step
                continue
            while raw[at + n] == raw[src + n]:
                n += 1
            break
        out.append((at, at - src, n))
        i = int(np.searchsorted(places, at + n))
    return out


def _fields(px: np.ndarray, width: int, found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(green counts, distance counts, [green symbols, extra, bits, distance symbols or -1, extra, bits] in order)."""
    if not found:
        return np.bincount(px, minlength=280), np.zeros(40, np.int64), [px.astype(np.int64)]
    at, d, n = (np.array(x, np.int64) for x in zip(*found, strict=True))
    if width not in _NEAR_CODE:
        _NEAR_CODE[width] = {}
        for k, (dx, dy) in enumerate(NEAR):
            _NEAR_CODE[width].setdefault(max(1, dx + dy * width), k + 1)
    near = _NEAR_CODE[width]
    code = np.fromiter((near.get(x, x + len(NEAR)) for x in d.tolist()), np.int64, len(d))
    edge = np.zeros(len(px) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    keep = np.cumsum(edge[:-1]) == 0
    keep[at] = True  # the reference stands where its run began
    place = np.flatnonzero(keep)
    green, ref = px[place].astype(np.int64), np.searchsorted(place, at)
    zero = np.zeros(len(place), np.int64)
    ge, gb, fs, fe, fb = zero.copy(), zero.copy(), zero - 1, zero.copy(), zero.copy()
    s, ge[ref], gb[ref] = _prefixed(n)
    green[ref] = 256 + s
    fs[ref], fe[ref], fb[ref] = _prefixed(code)
    return np.bincount(green, minlength=280), np.bincount(fs[ref], minlength=40), [green, ge, gb, fs, fe, fb]


def _put_image(w: BitWriter, px: np.ndarray, width: int, alpha: int, main: bool) -> np.ndarray:
    """Bits (0 or 1 each) of the stream so far and an image whose pixels differ in green only, with references where these make it shorter."""
    found = matches(px)
    green, far, fields = _fields(px, width, [])
    if found:
        other = _fields(px, width, found)
        # By entropy, and a few bits for each symbol of a code that is written.
        size = [_bits(x[0]) + _bits(x[1]) + 6 * (np.count_nonzero(x[0]) + np.count_nonzero(x[1])) + sum(int(x[2][k].sum()) for k in (2, 5) if len(x[2]) > k) for x in ((green, far, fields), other)]
        if size[1] < size[0]:
            green, far, fields = other
    gl, fl = code_lengths(green.tolist()), code_lengths(far.tolist())
    w.put(0, 2 if main else 1)  # no colour cache; one group of codes
    w.prefix(gl)
    for only in (0, 0, alpha):
        w.put(0b01, 2)  # a simple code of one symbol
        w.put(only > 1, 1)
        w.put(only, 8 if only > 1 else 1)
    w.prefix(fl)
    head = np.unpackbits(np.frombuffer(w.bytes(), np.uint8), bitorder="little")[: w.size]

    def coded(lengths: list[int], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if np.count_nonzero(lengths) == 1:
            return np.zeros_like(symbols), np.zeros_like(symbols)
        # The last entry serves what isn't there (-1).
        return np.array([*written_codes(lengths), 0], np.int64)[symbols], np.array([*lengths, 0], np.int64)[symbols]

    value, size = coded(gl, fields[0])
    if len(fields) > 1:
        far, far_size = coded(fl, fields[3])
        value = np.stack((value, fields[1], far, fields[4]), 1).ravel()
        size = np.stack((size, fields[2], far_size, fields[5]), 1).ravel()
        value, size = value[size > 0], size[size > 0]
    start = np.cumsum(size) - size
    body = (np.repeat(value, size) >> (np.arange(int(size.sum())) - np.repeat(start, size)) & 1).astype(np.uint8)
    return np.concatenate((head, body))


def _header(width: int, height: int) -> BitWriter:
    w = BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    return w


def _file(bits: np.ndarray) -> bytes:
    return riff(np.packbits(bits, bitorder="little").tobytes())


#: log2 of the side of a predictor block.
BLOCK = 4


def predictions(grey: np.ndarray) -> np.ndarray:
    """(14, height, width) predictions of a grey image by mode; the first row and column as the format has them."""
    h, width = grey.shape
    flat = np.concatenate((np.zeros(width + 1, np.int64), grey.ravel().astype(np.int64), np.zeros(1, np.int64)))
    here = np.arange(h * width) + width + 1
    left, top, corner, right = (flat[here - d].reshape(h, width) for d in (1, width, width + 1, width - 1))

    def mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) >> 1

    # The other channels of grey are equal and alpha is constant, so sums over channels compare as one channel does.
    pick = np.where(abs(top - corner) < abs(left - corner), left, top)
    half = mean(left, top)
    slope = half - corner
    out = np.stack([
        np.zeros_like(left), left, top, right, corner, mean(mean(left, right), top), mean(left, corner), half, mean(corner, top), mean(top, right),
        mean(mean(left, corner), mean(top, right)), pick, np.clip(left + top - corner, 0, 255), np.clip(half + np.sign(slope) * (abs(slope) // 2), 0, 255),
    ])
    out[:, 0, :], out[:, :, 0] = left[0], top[:, 0]
    out[:, 0, 0] = 0
    return out


def _bits(n: np.ndarray) -> float:
    """Bits of symbols with these counts under an ideal code."""
    n = n[n > 0].astype(np.float64)
    return float(-(n * np.log2(n / n.sum())).sum()) if len(n) else 0.0


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A lossless file of opaque grey pixels: the shortest of the ways that the payload suggests.

    Always literals or back references behind subtract-green; a palette of packed indices
    for up to 16 values; a predictor, a mode for each block, where the neighbour to the left
    or above foretells pixels (by entropy).
    """
    height = len(samples) // width
    values = np.flatnonzero(np.bincount(samples, minlength=256))
    w = _header(width, height)
    w.put(0b0101, 4)  # a transform follows: subtract green; then no further transform
    files = [_file(_put_image(w, samples, width, 255, True))]
    if len(values) <= 16:
        shift = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        w = _header(width, height)
        w.put(0b111101, 6)  # subtract green, then a palette: undone the other way round, so its colours differ in green only
        w.put(len(values) - 1, 8)
        w.put(0, 1)  # its colours as differences, literals without a cache
        steps = np.diff(np.concatenate(([0], values)))
        lengths = code_lengths(np.bincount(steps, minlength=280).tolist())
        for own in (lengths, [1], [1], code_lengths([len(values) - 1, *[0] * 254, 1]), [1]):
            w.prefix(own)
        codes, single = written_codes(lengths), sum(n > 0 for n in lengths) == 1
        for i, step in enumerate(steps.tolist()):
            w.put(codes[step] * (not single), lengths[step] * (not single))
            if len(values) > 1:
                w.put(i == 0, 1)
        w.put(0, 1)  # no further transform
        index = np.searchsorted(values, samples).reshape(height, -1, 1 << shift) << (np.arange(1 << shift) * (8 >> shift))
        files.append(_file(_put_image(w, index.sum(2).astype(np.uint8).ravel(), width >> shift, 255, True)))
    grey = samples.reshape(height, width)
    plain = _bits(np.bincount(samples))
    sides = [_bits(np.bincount((x[1:] - x[:-1]).ravel())) for x in (samples, grey)]
    if height > 1 and len(values) > 1 and min(sides) < 0.97 * plain:
        rest = (grey[None].astype(np.int64) - predictions(grey)) & 255
        cost = np.minimum(rest, 256 - rest)
        rows, columns = _div(height, 1 << BLOCK), _div(width, 1 << BLOCK)
        room = np.zeros((14, rows << BLOCK, columns << BLOCK), np.int64)
        room[:, :height, :width] = cost
        mode = room.reshape(14, rows, 1 << BLOCK, columns, 1 << BLOCK).sum((2, 4)).argmin(0)
        at = np.repeat(np.repeat(mode, 1 << BLOCK, 0), 1 << BLOCK, 1)[:height, :width]
        residual = np.take_along_axis(rest, at[None], 0)[0].astype(np.uint8)
        w = _header(width, height)
        w.put(0b001, 3)  # a predictor
        w.put(BLOCK - 2, 3)
        bits = _put_image(w, mode.astype(np.uint8).ravel(), columns, 255, False)
        w = BitWriter()
        w.put(0b0101, 4)  # then subtract green, and no further transform
        files.append(_file(np.concatenate((bits, _put_image(w, residual.ravel(), width, 0, True)))))
    return min(files, key=len)


#: Samples in a row of an image, and bytes of a payload in one image at most.
WIDTH, PIECE = 64, 1 << 18


def store(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as grey pixels: one file, or several in a row beyond PIECE bytes, so that memory beside the payload stays bounded."""
    samples = np.frombuffer(payload, np.uint8)
    return b"".join(encode_grey(samples[i : i + PIECE], WIDTH) for i in range(0, len(samples), PIECE))


def load(stored: bytes, size: int) -> np.ndarray:
    """The ``size`` samples of the files of ``store``, decoded from their bytes."""
    out, filled, at = np.empty(size, np.uint8), 0, 0
    while at < len(stored):
        end = at + 8 + struct.unpack_from("<I", stored, at + 4)[0]
        pixels = decode_argb(stored[at:end]).ravel()
        if end > len(stored) or filled + len(pixels) > size:
            raise ValueError("files that do not hold the payload")
        out[filled : filled + len(pixels)] = pixels >> np.uint32(8) & np.uint32(255)
        at, filled = end, filled + len(pixels)
    if filled < size:
        raise ValueError("files that do not hold the payload")
    return out


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy, distinct values and mean row-to-row change of the pixels read back."""
    n, steps = np.zeros(256, np.int64), 0
    for i in range(0, len(samples), PIECE):
        n += np.bincount(samples[i : i + PIECE], minlength=256)
        steps += int(np.abs(np.diff(samples[i : i + PIECE + 1].astype(np.int16))).sum(dtype=np.int64))
    p = n[n > 0] / len(samples)
    value = np.arange(256)
    mean = float((n * value).sum()) / len(samples)
    spread = max(0.0, float((n * value * value).sum()) / len(samples) - mean * mean) ** 0.5
    step = steps / (len(samples) - 1)
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};distinct={int((n > 0).sum())};step={step:.4f}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored files), payload_* and features read back from them.

    Null text is no bytes, stored as 64 zeros; equal texts give equal media; rows are
    independent and nothing moves between tasks.  A text beyond PIECE bytes is several files
    in a row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                stored = store(raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)))
                back = load(stored, max(64, -(-len(raw) // 64) * 64))
                read = back.tobytes()
                out.append((key, len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back), stored))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(9)], [*names, "media"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)
