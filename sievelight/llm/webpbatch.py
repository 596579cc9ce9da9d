"""Lossless WebP images in batches: an encoder that chooses a coding by content, and a decoder that reads many images in step.

Encoder: an image is coded as it is, or after a predictor (the pixel to the left, or above), a
cross-colour or a palette transform, whichever is estimated to take the fewest bits. Repeats of
six pixels or more become back-references, and a colour cache is used where it has hits enough.
Its prefix codes are one of a few made by rule for kinds of texts, or codes of its own where these
save more than they take.

Decoder: the images of a batch give one pixel each in every step. The next bits of all are looked
up in tables of their own codes; a back-reference goes on for as many steps as it is long. Codes
that repeat from image to image are parsed once. Images with codes by region are left to
``webp.decode``.
"""

from __future__ import annotations

import heapq
import struct
from collections import OrderedDict
from functools import cache
from typing import NamedTuple

import numpy as np

from sievelight.llm import webp
from sievelight.llm.webp import ORDER, Bits, Writer, near, prefixed

CACHE_BITS = 8
HASH = 0x1E35A7BD  # fixed by the format
GREEN, LENGTHS, DISTANCES = 256, 24, 40  # fixed by the format
#: Pixels of a back-reference: at least, and at most (fixed by the format).
SHORTEST, LONGEST = 6, 4_096
#: Longest code of a literal's sample: four of them fit one look at 57 bits.
LIMIT = 14
#: Pixels from which codes of its own are tried.
OWN_PIXELS = 1_024
#: Heads of images that are remembered.
KNOWN = 64

_r = np.arange(1 << 16, dtype=np.uint32)
for _shift, _mask in ((1, 0x5555), (2, 0x3333), (4, 0x0F0F), (8, 0x00FF)):
    _r = (_r >> _shift & _mask) | (_r & _mask) << _shift
REVERSED = _r.astype(np.uint64)


# --- prefix codes


def code_lengths(weights: np.ndarray, limit: int) -> np.ndarray:
    """Huffman code lengths of symbols with a weight; the weights are flattened until no code is longer than the limit."""
    used = np.flatnonzero(weights)
    out = np.zeros(len(weights), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = weights[used].astype(np.int64)
    while True:
        heap, up = [(w, i) for i, w in enumerate(weight.tolist())], [0] * (2 * len(used) - 1)
        heapq.heapify(heap)
        for made in range(len(used), len(up)):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = made
            heapq.heappush(heap, (a[0] + b[0], made))
        depth = [0] * len(up)
        for i in range(len(up) - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(used)]) <= limit:
            out[used] = depth[: len(used)]
            return out
        weight = (weight >> 1) + 1


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of symbols by their lengths, first bit lowest; of a single symbol, no bits."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.uint64)
    if len(used) < 2:
        return out
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used]
    # a code is the sum of the shares of all before it
    before = np.concatenate([[0], np.cumsum(1 << (15 - size[:-1]))])
    out[used] = REVERSED[before << 1] & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))
    return out


@cache
def _reversed(bits: int) -> np.ndarray:
    return (REVERSED[: 1 << bits] >> np.uint64(16 - bits)).astype(np.int64)


def table_of(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(symbol << 6 | length of its code) by the next bits, and how many bits these are."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return np.array([used[0] << 6 if len(used) else 0], np.int64), 0
    bits = int(lengths.max())
    used = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[used]
    # codes follow each other: with the first bit highest, each has a run of places
    return np.repeat(used << 6 | size, 1 << (bits - size))[_reversed(bits)], bits


def put_code(w: Writer, lengths: np.ndarray) -> None:
    """A prefix code's lengths: one or no symbol as a simple code, else runs of lengths under a code of their own."""
    used = np.flatnonzero(lengths)
    if len(used) < 2 and not (len(used) and used[0] > 255):
        symbol = int(used[0]) if len(used) else 0
        w.put(1 | (symbol > 1) << 2, 3)
        w.put(symbol, 8 if symbol > 1 else 1)
        return
    tokens: list[tuple[int, int, int]] = []
    edges = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1], [True]])).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        value, n = int(lengths[a]), b - a
        if value:
            tokens.append((value, 0, 0))
            n -= 1
        while n >= 3:
            step = min(n, 6 if value else 138)
            tokens.append((16, step - 3, 2) if value else (17, step - 3, 3) if step < 11 else (18, step - 11, 7))
            n -= step
        tokens += [(value, 0, 0)] * n
    inner = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = canonical(inner).tolist()
    single = np.count_nonzero(inner) < 2
    w.put(0, 1)
    count = max(4, 1 + max(i for i, s in enumerate(ORDER) if inner[s]))
    w.put(count - 4, 4)
    for s in ORDER[:count]:
        w.put(int(inner[s]), 3)
    w.put(0, 1)
    for symbol, extra, n in tokens:
        w.put(codes[symbol], 0 if single else int(inner[symbol]))
        w.put(extra, n)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance from 1."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * extra + 2 + (value >> extra & 1), value & (1 << extra) - 1, extra


# --- codes by rule


class Codes(NamedTuple):
    """Lengths and codes of green (with lengths and cache), red, blue and alpha samples and of distances."""

    lengths: tuple
    codes: tuple
    cache_bits: int
    head: tuple[int, int]  # bits from the cache's flag to the last code: value and number

    @staticmethod
    def of(lengths: list[np.ndarray], cache_bits: int) -> Codes:
        w = Writer()
        w.put(1 if cache_bits else 0, 1)
        if cache_bits:
            w.put(cache_bits, 4)
        w.put(0, 1)  # one group of codes for all regions
        shown, codes, coded = [], [], None
        for k, x in enumerate(lengths):
            if k and x is lengths[k - 1]:  # as the one before
                w.put(*coded)
                shown.append(shown[-1])
                codes.append(codes[-1])
                continue
            own = Writer()
            put_code(own, x)
            coded = own.value, own.size
            w.put(*coded)
            # a single symbol takes no bits
            shown.append(np.where(np.count_nonzero(x) < 2, 0, x).astype(np.uint64))
            codes.append(canonical(x))
        return Codes(tuple(shown), tuple(codes), cache_bits, (w.value, w.size))


#: Letters of a language, the most frequent first, in its usual order.
LETTERS = {"en": "etaoinshrdlcumwfgypbvkjxqz", "de": "enisratdhulcgmobwfkzpvjyxq", "fr": "esaitnrulodcpmvqfbghjxyzkw", "es": "eaosrnidlctumpbgvyqhfzjxkw"}
#: Kinds of text: a language, and how many of a thousand bytes begin an accented letter.
KINDS = [("en", 2), *((x, n) for x in ("de", "fr", "es") for n in (20, 60)), ("figures", 0), ("flat", 0)]


def sample_weights(kind: str, accents: int) -> np.ndarray:
    """How often bytes are expected in a kind of text: each letter by an eighth less often than the one before."""
    w = np.full(256, 2, np.int64)
    if kind == "flat":
        return w
    w[33:127], w[128:192] = 12, 6
    w[[0, 10, 33, 44, 46]], w[32] = 30, 1_500
    if kind == "figures":
        w[48:58], w[65:91], w[97:123] = 700, 80, 80
        return w
    order = np.frombuffer(LETTERS[kind].encode(), np.uint8)
    w[order] = 1_150 * 0.88 ** np.arange(26)
    w[order - 32] = 90 * 0.88 ** np.arange(26) + 4
    w[0xC3] = 10 * accents
    w[0xA0:0xC0] += accents // 2
    return w


@cache
def ruled_codes() -> list[Codes]:
    out = []
    for cache_bits in (0, CACHE_BITS):
        for kind in KINDS:
            w = sample_weights(*kind)
            total = int(w.sum())
            green = np.concatenate([w, np.full(LENGTHS, max(1, total // 1_500)), np.full(1 << cache_bits if cache_bits else 0, max(1, total // 1_600))])
            sample = code_lengths(w, LIMIT)
            out.append(Codes.of([code_lengths(green, LIMIT), sample, sample, sample, code_lengths(np.ones(DISTANCES, np.int64), LIMIT)], cache_bits))
    return out


# --- transforms, forwards


def _argb(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) bytes as red, green, blue, alpha to integers."""
    p = pixels.astype(np.uint32)
    return p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]


def _put_pixels(w: Writer, argb: np.ndarray) -> None:
    """A small image within a transform: codes of its own, no cache and no references."""
    samples = [(argb >> s & 255).astype(np.int64) for s in (8, 16, 0, 24)]
    w.put(0, 1)
    coded = []
    for x, size in zip(samples, (GREEN + LENGTHS, 256, 256, 256), strict=True):
        lengths = code_lengths(np.bincount(x, minlength=size), LIMIT)
        put_code(w, lengths)
        coded.append((canonical(lengths)[x].tolist(), lengths[x].tolist() if np.count_nonzero(lengths) > 1 else [0] * len(x)))
    put_code(w, np.zeros(DISTANCES, np.int64))
    for i in range(len(argb)):
        for codes, sizes in coded:
            w.put(codes[i], sizes[i])


def transformed(pixels: np.ndarray, kind: str) -> tuple[Writer, np.ndarray]:
    """The transform's bits, and the (height, width) pixels that are coded after it."""
    height, width, _ = pixels.shape
    w = Writer()
    if kind in ("left", "above"):
        out = pixels.copy()
        along = kind == "left"
        if along:
            out[:, 1:] -= pixels[:, :-1]
            out[1:, 0] -= pixels[:-1, 0]
        else:
            out[1:] -= pixels[:-1]
            out[0, 1:] -= pixels[0, :-1]
        out[0, 0, 3] += 1  # the first is predicted as opaque black
        w.put(1 | 0 << 1 | 7 << 3, 6)
        _put_pixels(w, np.full(-(-width >> 9) * -(-height >> 9), (1 if along else 2) << 8, np.uint32))
    elif kind == "cross":
        out = pixels.copy()
        out[..., 0] -= pixels[..., 1]
        out[..., 2] -= pixels[..., 1]
        w.put(1 | 1 << 1 | 7 << 3, 6)
        _put_pixels(w, np.full(-(-width >> 9) * -(-height >> 9), 32 << 8 | 32, np.uint32))
    else:
        colours, index = np.unique(_argb(pixels.reshape(-1, 4)), return_inverse=True)
        channels = np.diff(colours.astype(">u4").view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint32)
        w.put(1 | 3 << 1 | (len(colours) - 1) << 3, 11)
        _put_pixels(w, channels[:, 0] << 24 | channels[:, 1] << 16 | channels[:, 2] << 8 | channels[:, 3])
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        each, wide = 1 << bits, (width + (1 << bits) - 1) >> bits
        grid = np.zeros((height, wide * each), np.uint32)
        grid[:, :width] = index.reshape(height, width)
        packed = (grid.reshape(height, wide, each) << (np.arange(each, dtype=np.uint32) * np.uint32(8 >> bits))).sum(2, dtype=np.uint32)
        return w, packed << 8 | np.uint32(0xFF000000)
    return w, _argb(out.reshape(-1, 4)).reshape(height, width)


# --- the encoder


def _by_image(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, start[:-1])


def choose_transforms(images: list[np.ndarray], argb: np.ndarray, start: np.ndarray, widths: np.ndarray, hits: np.ndarray, plain: np.ndarray) -> list[str | None]:
    """The transform of each image that is estimated to save a tenth at least, if any. ``plain``: bits of the images as they are; ``hits``: of the cache."""
    n = np.diff(start)
    place = np.arange(len(argb))
    begin = np.repeat(start[:-1], n)
    above = np.maximum(place - np.repeat(widths, n), begin)
    beside = np.maximum(place - 1, begin)
    grey = ((argb >> np.uint32(8)) ^ argb) & np.uint32(0xFFFF)
    # images in which many pixels repeat one that is near, or are grey, are looked at closely
    marked = np.maximum.reduce([_by_image((x == y).astype(np.int64), start) for x, y in ((argb, argb[beside]), (argb, argb[above]), (grey, 0))] + [hits])
    out: list[str | None] = [None] * len(images)
    worth = 1 + 2 * np.log2(1 + np.minimum(np.arange(256), 256 - np.arange(256)))
    for i in np.flatnonzero(4 * marked >= n).tolist():
        flat = images[i].reshape(-1, 4)
        bits = {"cross": worth[flat[:, 0] - flat[:, 1]].sum() + worth[flat[:, 2] - flat[:, 1]].sum() + plain[i] / 2 + 300}
        for kind, back in (("left", 1), ("above", int(widths[i]))):
            bits[kind] = worth[flat[back:] - flat[:-back]].sum() + 32 * min(back, len(flat)) + 200
        colours = len(np.unique(argb[start[i] : start[i + 1]]))
        if colours <= 64:
            bits["palette"] = len(flat) * np.ceil(np.log2(colours)) + 26 * colours + 300
        best = min(bits, key=bits.get)
        if 10 * bits[best] < 9 * plain[i]:
            out[i] = best
    return out


def _sorted_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of up to 32 bits in order, and the places where they are, of equal ones the first first."""
    both = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
    return both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def find_repeats(argb: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of back-references, greedily from the left, over images that lie end to end."""
    n = len(argb) - SHORTEST + 1
    if n < 2:
        return []
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    key = owner[:n].astype(np.uint64)
    for i in range(SHORTEST):
        key = key * np.uint64(0x9E3779B97F4A7C15) + argb[i : n + i] + np.uint64(1)
        key ^= key >> np.uint64(29)
    key, order = _sorted_places(key >> np.uint64(32))
    same = key[1:] == key[:-1]
    at, before = order[1:][same], order[:-1][same]
    real = (owner[at] == owner[before]) & (owner[at] == owner[at + SHORTEST - 1])
    for i in range(SHORTEST):
        real &= argb[at + i] == argb[before + i]
    at, before = at[real], before[real]
    ordered = np.argsort(at)
    out, free = [], 0
    for i, j in zip(at[ordered].tolist(), before[ordered].tolist(), strict=True):
        if i < free:
            continue
        end = min(int(start[owner[i] + 1]), i + LONGEST)
        differs = argb[i:end] != argb[j : j + end - i]
        size = int(differs.argmax()) if differs.any() else end - i
        out.append((i, size, i - j))
        free = i + size
    return out


def cache_hits(argb: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pixel is what the colour cache holds in its place, and that place."""
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    slot = (argb * np.uint32(HASH)) >> np.uint32(32 - CACHE_BITS)
    key, order = _sorted_places(owner << CACHE_BITS | slot)
    hit = np.zeros(len(argb), bool)
    hit[order[1:]] = (key[1:] == key[:-1]) & (argb[order[1:]] == argb[order[:-1]])
    return hit, slot


def _own_codes(argb: np.ndarray, hit: np.ndarray, slot: np.ndarray, repeats: list[tuple[int, int, int]], cache_bits: int, shared: bool) -> Codes:
    """Codes fitted to one image; ``shared``: red, blue and alpha have one. ``hit``: pixels from the cache; pixels of repeats are in neither."""
    covered = np.zeros(len(argb), bool)
    extra = np.zeros(LENGTHS, np.int64)
    far = np.zeros(DISTANCES, np.int64)
    for at, size, distance in repeats:
        covered[at : at + size] = True
        extra[prefix_of(size)[0]] += 1
        far[prefix_of(distance + 120)[0]] += 1
    plain = argb[~covered & ~hit]
    count = lambda s: np.bincount(plain >> s & 255, minlength=256)
    first, *others = (count(s) for s in (8, 16, 0, 24))
    if shared:  # text: samples are alike in all channels
        others = [first + sum(others)] * 3
        first = others[0] // 4 + first
    green = np.concatenate([first, extra, np.bincount(slot[hit & ~covered], minlength=1 << cache_bits) if cache_bits else np.zeros(0, np.int64)])
    same = code_lengths(others[0], LIMIT) if shared else None
    return Codes.of([code_lengths(green, LIMIT), *(same if shared else code_lengths(x, LIMIT) for x in others), code_lengths(far, LIMIT)], cache_bits)


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """(height, width, 4) bytes as red, green, blue, alpha, each as a lossless WebP file; equal images give equal files."""
    if not images:
        return []
    ruled = ruled_codes()
    half = len(ruled) // 2
    sides = [(x.shape[1], x.shape[0]) for x in images]
    flat = np.concatenate([x.reshape(-1, 4) for x in images])
    start = np.concatenate([[0], np.cumsum([w * h for w, h in sides])])
    argb = _argb(flat)
    n = np.diff(start)
    owner = np.repeat(np.arange(len(n)), n)
    samples = np.bincount((owner[:, None] << 8 | flat).ravel(), minlength=len(n) << 8).reshape(-1, 256)
    bits = samples @ np.stack([c.lengths[1] for c in ruled[:half]], 1).astype(np.float64) + [c.head[1] for c in ruled[:half]]
    family, plain = bits.argmin(1), bits.min(1)
    # codes of its own: what the samples of an image hold, the codes, and a fifth to be worth it
    share = np.log2(4 * np.maximum(n, 1))[:, None] - np.log2(np.maximum(samples, 1))
    own = (n >= OWN_PIXELS) & (1.25 * ((samples * share).sum(1) + 1_200) < plain)
    hit, slot = cache_hits(argb, start)
    kinds = choose_transforms(images, argb, start, np.array([w for w, _ in sides]), _by_image(hit.astype(np.int64), start), plain)
    heads: list[Writer] = [Writer() for _ in images]
    if any(kinds):
        coded = [argb[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
        for i, kind in enumerate(kinds):
            if kind:
                heads[i], made = transformed(images[i], kind)
                coded[i] = made.ravel()
        argb = np.concatenate(coded)
        start = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
        hit, slot = cache_hits(argb, start)
    n = np.diff(start)
    repeats: list[list[tuple[int, int, int]]] = [[] for _ in images]
    covered = np.zeros(len(argb), bool)
    for at, size, distance in find_repeats(argb, start):
        covered[at : at + size] = True
        i = int(np.searchsorted(start, at, "right")) - 1
        repeats[i].append((at - int(start[i]), size, distance))
    hit &= ~covered
    hits = _by_image(hit.astype(np.int64), start)
    cached = (hits * (plain / np.maximum(n, 1) - 10) > 0.3 * n + ruled[half].head[1] - ruled[0].head[1]) & np.array([k is None for k in kinds])
    hit &= np.repeat(cached, n)
    every, chosen = list(ruled), (family + half * cached).astype(np.int64)
    for i in range(len(images)):
        if kinds[i] or own[i]:
            a, b = int(start[i]), int(start[i + 1])
            chosen[i] = len(every)
            every.append(_own_codes(argb[a:b], hit[a:b], slot[a:b], repeats[i], CACHE_BITS if cached[i] else 0, kinds[i] is None))
    return _written(sides, argb, start, heads, every, chosen, covered, hit, slot, repeats)


def _written(sides, argb, start, heads, every, chosen, covered, hit, slot, repeats) -> list[bytes]:
    """The files: the bits of all pixels are placed at once."""
    n = np.diff(start)
    size = GREEN + LENGTHS + (1 << CACHE_BITS)
    # code << 6 | length of every symbol of every group of codes
    entry = [np.zeros((len(every), size if k == 0 else 256), np.uint64) for k in range(4)]
    for i, c in enumerate(every):
        for k in range(4):
            entry[k][i, : len(c.codes[k])] = c.codes[k] << np.uint64(6) | c.lengths[k]
    own = np.repeat(chosen, n)
    value, count = np.zeros(len(argb), np.uint64), np.zeros(len(argb), np.uint64)
    for k, s in enumerate((8, 16, 0, 24)):
        found = np.take(entry[k].ravel(), own * entry[k].shape[1] + (argb >> np.uint32(s) & np.uint32(255)))
        value |= found >> np.uint64(6) << count
        count += found & np.uint64(63)
    value[covered] = count[covered] = 0
    from_cache = np.flatnonzero(hit)
    symbol = GREEN + LENGTHS + slot[from_cache].astype(np.int64)
    found = entry[0][own[from_cache], symbol]
    value[from_cache], count[from_cache] = found >> np.uint64(6), found & np.uint64(63)
    for i, listed in enumerate(repeats):
        c = every[chosen[i]]
        for at, length, distance in listed:
            made = bits = 0
            for k, shift, (s, extra, more) in ((0, GREEN, prefix_of(length)), (4, 0, prefix_of(distance + 120))):
                made |= int(c.codes[k][s + shift]) << bits
                bits += int(c.lengths[k][s + shift])
                made |= extra << bits
                bits += more
            value[start[i] + at], count[start[i] + at] = made, bits
    whole = []
    for (width, height), head, k in zip(sides, heads, chosen.tolist(), strict=True):
        w = Writer()
        w.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
        w.put(head.value, head.size)
        w.put(0, 1)  # no more transforms
        w.put(*every[k].head)
        whole.append(w)
    total = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    ends = np.array([w.size for w in whole]) + total[start[1:]] - total[start[:-1]]
    taken = -(-ends // 8)
    offset = np.concatenate([[0], np.cumsum(taken)])
    place = total[:-1] + np.repeat(8 * offset[:-1] + [w.size for w in whole] - total[start[:-1]], n)
    words = np.zeros(int(offset[-1]) // 8 + 2, np.uint64)
    index, shift = place >> 6, (place & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    words[index[first]] = np.add.reduceat(value << shift, first)
    over = np.flatnonzero((shift > 0) & (shift + count > 64))
    words[index[over] + 1] += value[over] >> (np.uint64(64) - shift[over])
    data = words.view(np.uint8)
    out = []
    for w, a, b in zip(whole, offset[:-1].tolist(), offset[1:].tolist(), strict=True):
        head = np.frombuffer(w.value.to_bytes(-(-w.size // 8), "little"), np.uint8)
        data[a : a + len(head)] |= head
        body = data[a:b].tobytes()
        out.append(b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2))
    return out


# --- the decoder


class Head(NamedTuple):
    width: int
    height: int
    coded: int  # width of the pixels that are read
    undo: list
    cache_bits: int
    tables: tuple  # of green, red, blue, alpha and distance
    begin: int  # bit of the first pixel


_known: OrderedDict[bytes, tuple[int, int, int, tuple]] = OrderedDict()


def read_lengths(data: bytes, at: int, size: int) -> tuple[np.ndarray, int]:
    """The code lengths of ``size`` symbols that stand at a bit, and the bit after them."""
    look = lambda: int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)
    out = [0] * size
    v = look()
    if v & 1:
        wide = 8 if v & 4 else 1
        out[v >> 3 & (1 << wide) - 1] = 1
        if v & 2:
            out[v >> (3 + wide) & 255] = 1
        return np.array(out), at + 3 + wide + (8 if v & 2 else 0)
    count, at = 4 + (v >> 1 & 15), at + 5
    inner = np.zeros(19, np.int64)
    for i in range(count):
        inner[ORDER[i]] = look() & 7
        at += 3
    table, bits = table_of(inner)
    table, mask = table.tolist(), (1 << bits) - 1
    v, at = look(), at + 1
    most = size
    if v & 1:
        n = 2 + 2 * (v >> 1 & 7)
        most, at = 2 + (v >> 4 & (1 << n) - 1), at + 3 + n
    place, previous = 0, 8
    while place < size and most:
        most -= 1
        v = look()
        found = table[v & mask]
        s, n = found >> 6, found & 63
        at += n
        if s < 16:
            out[place] = s
            previous = s or previous
            place += 1
            continue
        more = (2, 3, 7)[s - 16]
        at += more
        run = (11 if s == 18 else 3) + (v >> n & (1 << more) - 1)
        if place + run > size:
            raise ValueError("too many code lengths")
        if s == 16:
            out[place : place + run] = [previous] * run
        place += run
    return np.array(out), at


def _bits(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & (1 << n) - 1


def read_head(data: bytes) -> Head | None:
    """What comes before the pixels of an image (a VP8L chunk's bytes); None if it has codes by region."""
    bits = Bits(data)
    width, height = webp.read_size(bits)
    undo: list = []
    key = data[5:21]
    if (found := _known.get(key)) and _bits(data, 40, found[0]) == found[1]:
        return Head(width, height, width, [], found[2], found[3], 40 + found[0])
    undo, coded = webp.read_transforms(bits, width, height)
    cache_bits = bits.read(4) if bits.read(1) else 0
    if bits.read(1):
        return None
    tables, begin = [], bits.position()
    before = None
    for n in (GREEN + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES):
        if n == 256 and before and _bits(data, begin, before[1]) == before[0]:  # the same code again
            tables.append(tables[-1])
            begin += before[1]
            continue
        lengths, end = read_lengths(data, begin, n)
        tables.append(table_of(lengths))
        before = (_bits(data, begin, end - begin), end - begin) if n == 256 else None
        begin = end
    tables = tuple(tables)
    if not undo:
        size = begin - 40
        _known[key] = size, _bits(data, 40, size), cache_bits, tables
        if len(_known) > KNOWN:
            _known.popitem(last=False)
    return Head(width, height, coded, undo, cache_bits, tables, begin)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """(height, width, 4) bytes as red, green, blue, alpha of each file."""
    out: list[np.ndarray | None] = [None] * len(files)
    heads, chunks, where = [], [], []
    for i, data in enumerate(files):
        body = webp.chunk_of(data)
        if head := read_head(body):
            heads.append(head)
            chunks.append(body)
            where.append(i)
        else:
            out[i] = webp.decode(data)
    for i, head, argb in zip(where, heads, read_in_step(heads, chunks), strict=True):
        pixels = argb.reshape(head.height, head.coded)
        for f, arguments in reversed(head.undo):
            pixels = f(pixels, *arguments)
        out[i] = webp.channels(pixels)[..., [1, 2, 3, 0]]
    return out


def read_in_step(heads: list[Head], chunks: list[bytes]) -> list[np.ndarray]:
    """The coded pixels of each image."""
    if not heads:
        return []
    total = np.array([h.coded * h.height for h in heads])
    order = np.argsort(-total, kind="stable")
    lanes = [heads[i] for i in order]
    offset = np.concatenate([[0], np.cumsum([len(chunks[i]) for i in order])])
    data = np.frombuffer(b"".join([*(chunks[i] for i in order), b"\0" * 16]), np.uint8)
    window = np.ndarray((len(data) - 7,), "<i8", data, strides=(1,)).copy()  # the eight bytes from each byte on
    at = 8 * offset[:-1] + [h.begin for h in lanes]
    last = 8 * offset[1:]
    # what a sample adds to the pixel above the six bits that sum the lengths; tables that lanes share are there once
    place: dict[tuple[int, int], int] = {}
    tables, size = [], 0
    for h in lanes:
        for k, s in enumerate((8, 16, 0, 24, 0)):
            table = h.tables[k][0]
            if (id(table), k) not in place:
                place[id(table), k] = size
                tables.append((table >> 6) << (s + 6) | table & 63)
                size += len(table)
    table = np.concatenate(tables)
    begin = [np.array([place[id(h.tables[k][0]), k] for h in lanes]) for k in range(5)]
    mask = [np.array([(1 << h.tables[k][1]) - 1 for h in lanes]) for k in range(5)]
    far_look = max(sum(h.tables[k][1] for k in range(4)) for h in lanes) > 57
    cache_bits = np.array([h.cache_bits for h in lanes])
    widest = int(cache_bits.max())
    kept = np.zeros((len(lanes), 1 << widest), np.uint32) if widest else None
    caching = np.flatnonzero(cache_bits)
    down = np.uint32(32) - cache_bits[caching].astype(np.uint32)
    sizes = total[order]
    base = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(base[-1]), np.uint32)
    to = base[:-1].copy()  # where each image's next pixel goes
    left, distance = np.zeros(len(lanes), np.int64), np.ones(len(lanes), np.int64)
    going = False  # whether some back-reference is under way
    room = [np.zeros(len(lanes), np.int64) for _ in range(4)]
    ends = np.flatnonzero(np.concatenate([sizes[1:] != sizes[:-1], [True]]))[::-1]  # last lane of each size, the smallest first
    step = 0
    for end in ends.tolist():
        n = end + 1
        now, index, look, found, both = at[:n], *(x[:n] for x in room)
        masks, begins, goal = [m[:n] for m in mask], [b[:n] for b in begin], to[:n]
        for step in range(step, int(sizes[end])):
            np.right_shift(now, 3, out=index)
            np.take(window, index, out=look, mode="clip")
            np.bitwise_and(now, 7, out=index)
            np.right_shift(look, index, out=look)
            for k in range(4):
                if k == 2 and far_look:
                    np.add(now, both & 63, out=index)
                    look[:] = np.take(window, index >> 3, mode="clip") >> (index & 7)
                np.bitwise_and(look, masks[k], out=index)
                np.add(index, begins[k], out=index)
                if k == 0:
                    np.take(table, index, out=both, mode="clip")
                    odd = both >= GREEN << 14
                    special = odd.any() or going
                    first = both.copy() if special else None
                    np.bitwise_and(both, 63, out=index)
                else:
                    np.take(table, index, out=found, mode="clip")
                    np.add(both, found, out=both)
                    np.bitwise_and(found, 63, out=index)
                if k < 3:
                    np.right_shift(look, index, out=look)
            pixel = (both >> 6).astype(np.uint32)
            if not special:
                np.bitwise_and(both, 63, out=index)
                np.add(now, index, out=now)
            else:
                symbol = first >> 14
                np.bitwise_and(both, 63, out=index)
                if going:
                    copying = np.flatnonzero(left[:n])
                    odd[copying] = False
                    index[copying] = 0
                own = np.flatnonzero(odd)
                index[own] = first[own] & 63
                np.add(now, index, out=now)
                again = odd & (symbol >= GREEN + LENGTHS)
                if again.any():
                    own = np.flatnonzero(again)
                    pixel[own] = kept[own, symbol[own] - GREEN - LENGTHS]
                for i in np.flatnonzero(odd & ~again).tolist():
                    bits = Bits(data[at[i] >> 3 : (at[i] >> 3) + 16].tobytes())
                    bits.read(int(at[i]) & 7)
                    length = prefixed(bits, int(symbol[i]) - GREEN)
                    far = int(table[begin[4][i] + (bits.peek() & int(mask[4][i]))])
                    bits.read(far & 63)
                    far = prefixed(bits, far >> 6)
                    if far > 120:
                        far -= 120
                    else:
                        x, y = near()[far - 1]
                        far = max(1, x + y * lanes[i].coded)
                    if far > step:
                        raise ValueError("a back-reference before the image")
                    at[i] = (int(at[i]) >> 3 << 3) + bits.position()
                    left[i], distance[i] = length, far
                copying = np.flatnonzero(left[:n])
                pixel[copying] = out[goal[copying] - distance[copying]]
                left[copying] -= 1
                going = bool((left[copying] > 0).any())
            out[goal] = pixel
            goal += 1
            if widest:
                c = np.searchsorted(caching, n)
                own = caching[:c]
                p = pixel[own]
                kept[own, (p * np.uint32(HASH)) >> down[:c]] = p
        step = int(sizes[end])
    if (at > last).any():
        raise ValueError("an image is cut short")
    result: list[np.ndarray] = [out[:0]] * len(heads)
    for k, i in enumerate(order.tolist()):
        result[i] = out[base[k] : base[k + 1]]
    return result
