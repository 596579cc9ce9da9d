"""Lossless WebP (VP8L): a full decoder of one image, symbol by symbol.

It reads prefix codes, also by region, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. ``webpbatch`` has the encoder, and
a decoder of many images at once that shares the heads and the transforms with this one.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

#: Order of code lengths of code lengths: fixed by the format.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MAX_SIDE = 16_383


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.value, self.have, self.at = data, 0, 0, 0

    def fill(self) -> None:
        more = self.data[self.at : self.at + 64]
        self.value |= int.from_bytes(more, "little") << self.have
        self.at += len(more)
        self.have += 8 * len(more)
        if not more:  # past the end there are zeros
            self.have += 64

    def read(self, n: int) -> int:
        while self.have < n:
            self.fill()
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.have -= n
        return out

    def peek(self) -> int:
        """The next bits, at least 15 of them."""
        while self.have < 15:
            self.fill()
        return self.value

    def position(self) -> int:
        return 8 * self.at - self.have


class Code:
    """A canonical prefix code: symbols found bit by bit."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.lengths = lengths
        self.only = used[0][1] if len(used) == 1 else None
        self.table: dict[tuple[int, int], int] = {}
        code, last = 0, 0
        for n, s in sorted(used):
            code <<= n - last
            last = n
            self.table[n, code] = s
            code += 1
        if not used:
            self.only = 0

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        code = n = 0
        while True:
            code, n = code << 1 | bits.read(1), n + 1
            if (found := self.table.get((n, code))) is not None:
                return found
            if n > 15:
                raise ValueError("no such prefix code")


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    inner = [0] * 19
    for i in range(4 + bits.read(4)):
        inner[ORDER[i]] = bits.read(3)
    code = Code(inner)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, previous = 0, 8
    while at < size and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            previous = s or previous
            at += 1
            continue
        n, value = (3 + bits.read(2), previous) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if at + n > size:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    return Code(lengths)


def prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


@cache
def near() -> list[tuple[int, int]]:
    """Places of the first 120 distances, left and up of a pixel: fixed by the format."""
    text = (
        "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 "
        "2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 "
        "3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
    )
    return [tuple(map(int, p.split(","))) for p in text.split()]


def read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as ARGB integers; only the top one may choose codes by region."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    regions, region_bits = None, 0
    if top and bits.read(1):
        region_bits = bits.read(3) + 2
        regions = (read_pixels(bits, (width + (1 << region_bits) - 1) >> region_bits, (height + (1 << region_bits) - 1) >> region_bits, False) >> 8) & 0xFFFF
    groups = [[read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(1 + (int(regions.max()) if regions is not None else 0))]
    total, out, at, kept = width * height, [0] * (width * height), 0, [0] * (1 << cache_bits)
    across = (width + (1 << region_bits) - 1) >> region_bits if region_bits else 0
    flat_regions = regions.ravel().tolist() if regions is not None else []
    while at < total:
        group = groups[flat_regions[((at // width) >> region_bits) * across + ((at % width) >> region_bits)]] if flat_regions else groups[0]
        s = group[0].read(bits)
        if s < 256:
            made = [s << 8 | group[1].read(bits) << 16 | group[2].read(bits) | group[3].read(bits) << 24]
        elif s < 280:
            length = prefixed(bits, s - 256)
            far = prefixed(bits, group[4].read(bits))
            if far > 120:
                far -= 120
            else:
                x, y = near()[far - 1]
                far = max(1, x + y * width)
            if far > at:
                raise ValueError("a back-reference before the image")
            made = [out[at - far + i % far] for i in range(min(length, total - at))]
        else:
            made = [kept[s - 280]]
        for p in made:
            out[at] = p
            at += 1
            if cache_bits:
                kept[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32).reshape(height, width)


def channels(argb: np.ndarray) -> np.ndarray:
    """(height, width, 4) bytes as alpha, red, green, blue."""
    return np.ascontiguousarray(argb.astype(">u4")).view(np.uint8).reshape(*argb.shape, 4)


def _spread(block: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(block, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def predicted(mode: int, left, up, up_right, up_left):
    """A pixel (four channels) from its neighbours."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: min(255, max(0, x))
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode == 11:
        p = [x + y - z for x, y, z in zip(left, up, up_left, strict=True)]
        by_left = sum(abs(a - b) for a, b in zip(p, left, strict=True))
        return left if by_left < sum(abs(a - b) for a, b in zip(p, up, strict=True)) else up
    if mode == 12:
        return [clamp(x + y - z) for x, y, z in zip(left, up, up_left, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - z) / 2)) for m, z in zip(half(left, up), up_left, strict=True)]
    plain = {1: left, 2: up, 3: up_right, 4: up_left}
    return plain[mode] if mode in plain else {5: lambda: half(half(left, up_right), up), 6: lambda: half(left, up_left), 7: lambda: half(left, up), 8: lambda: half(up_left, up), 9: lambda: half(up, up_right), 10: lambda: half(half(left, up_left), half(up, up_right))}[mode]()


def unpredict(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    kinds = np.unique((modes >> 8) & 0xF).tolist()
    if kinds in ([1], [2]):  # sums along the rows, or along the columns
        c = channels(argb).copy()
        c[0, 0, 0] -= 1  # the first is predicted as opaque black: 255 more
        edge = c[:, 0] if kinds == [1] else c[0]
        np.cumsum(edge, axis=0, dtype=np.uint8, out=edge)
        np.cumsum(c, axis=1 if kinds == [1] else 0, dtype=np.uint8, out=c)
        return np.ascontiguousarray(c).view(">u4")[..., 0].astype(np.uint32)
    out, mode = channels(argb).astype(int).tolist(), _spread((modes >> 8) & 0xF, bits, height, width).tolist()
    for y in range(height):
        for x in range(width):
            if x and y:
                up = out[y - 1]
                guess = predicted(mode[y][x], out[y][x - 1], up[x], up[x + 1] if x + 1 < width else out[y][0], up[x - 1])
            else:
                guess = out[y][x - 1] if x else out[y - 1][0] if y else [255, 0, 0, 0]
            out[y][x] = [(a + b) & 255 for a, b in zip(out[y][x], guess, strict=True)]
    a = np.array(out, np.uint32)
    return a[..., 0] << 24 | a[..., 1] << 16 | a[..., 2] << 8 | a[..., 3]


def uncross(argb: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    c, f = channels(argb), channels(_spread(factors, bits, *argb.shape))
    signed = lambda x: x.astype(np.int8).astype(np.int32)
    red_blue, green_blue, green_red = signed(f[..., 1]), signed(f[..., 2]), signed(f[..., 3])
    green = signed(c[..., 2])
    red = (c[..., 1] + (green_red * green >> 5)) & 255
    blue = (c[..., 3] + (green_blue * green >> 5) + (red_blue * signed(red.astype(np.uint8)) >> 5)) & 255
    return (argb & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def ungreen(argb: np.ndarray) -> np.ndarray:
    green = (argb >> 8) & 255
    return (argb & np.uint32(0xFF00FF00)) | (((argb >> 16) + green) & 255) << 16 | ((argb + green) & 255)


def unindex(argb: np.ndarray, palette: np.ndarray, bits: int, width: int) -> np.ndarray:
    index = (argb >> 8) & 255
    if bits:
        each = 8 >> bits
        parts = [(index >> (each * i)) & ((1 << each) - 1) for i in range(1 << bits)]
        index = np.stack(parts, -1).reshape(index.shape[0], -1)[:, :width]
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index]


def chunk_of(data: bytes) -> bytes:
    """The VP8L chunk of a file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if len(data) < 20 + size:
        raise ValueError("the file is cut short")
    return data[20 : 20 + size]


def read_size(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("an unknown version")
    return width, height


def read_transforms(bits: Bits, width: int, height: int) -> tuple[list, int]:
    """What is to be undone after the pixels are read (last first), and the width that they are coded in."""
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            n = bits.read(3) + 2
            block = read_pixels(bits, (coded + (1 << n) - 1) >> n, (height + (1 << n) - 1) >> n, False)
            undo.append((unpredict if kind == 0 else uncross, (block, n)))
        elif kind == 2:
            undo.append((ungreen, ()))
        else:
            count = bits.read(8) + 1
            table = np.cumsum(channels(read_pixels(bits, count, 1, False)[0]), axis=0, dtype=np.uint8).astype(np.uint32)
            packed = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append((unindex, (table[:, 0] << 24 | table[:, 1] << 16 | table[:, 2] << 8 | table[:, 3], packed, coded)))
            coded = (coded + (1 << packed) - 1) >> packed
    return undo, coded


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) bytes as red, green, blue, alpha."""
    bits = Bits(chunk_of(data))
    width, height = read_size(bits)
    undo, coded = read_transforms(bits, width, height)
    argb = read_pixels(bits, coded, height, True)
    for f, arguments in reversed(undo):
        argb = f(argb, *arguments)
    return channels(argb)[..., [1, 2, 3, 0]]


class Writer:
    def __init__(self):
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def encode(pixels: np.ndarray) -> bytes:
    """(height, width, 4) bytes as red, green, blue, alpha, as a lossless WebP file."""
    from sievelight.llm.webpbatch import encode_many

    return encode_many([pixels])[0]
