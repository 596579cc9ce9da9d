"""Vectorised word and n-gram hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Maximal runs of bytes that are not blank, tab, line ends, vertical tab or form feed.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Maximal runs of digits, a-z (A-Z once lower-cased) and every non-ASCII byte.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, raised to 0..n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        made = []
        for base in (BASE, INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        if size > 8 * CHUNK_BYTES:
            return made[0], made[1]  # of one very long text: not kept
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and n + 1 offsets; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows whose texts take up to limit bytes together, or of one longer text."""
    data, ends = text_buffer(column)
    first, n = 0, len(ends) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[ends[first] : ends[end]], ends[first : end + 1] - ends[first]
        first = end


class Words(NamedTuple):
    start: np.ndarray  # of each word in the bytes
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and at last the number of words
    hash: np.ndarray


def split_words(data: np.ndarray, ends: np.ndarray, kind: np.ndarray, lower: bool = True, hashed: bool = True, heads: tuple[int, ...] = ()) -> Words | tuple[Words, ...]:
    """Words (maximal runs of bytes of a kind) of texts that lie end to end; no word crosses texts. ``heads``: also hash words cut to so many bytes."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = kind[data]
    step = np.diff(inside)
    if len(ends) > 2:
        cut = ends[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < n)])
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # a word ends where the next text begins with one
    else:
        cut = np.zeros(0, np.int64)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    first = np.searchsorted(start, ends)
    if not hashed:
        return Words(start, end, first, np.zeros(0, np.uint64))
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.multiply((BYTE_CODE[LOWER] if lower else BYTE_CODE)[data], up[:n], out=total[1:])
    np.cumsum(total, out=total)
    value = (total[end] - total[start]) * down[start]
    words = Words(start, end, first, mix(value + (end - start).astype(np.uint64)))
    if not heads:
        return words
    cut = [np.minimum(end, start + n) for n in heads]
    return (words, *[Words(start, c, first, mix((total[c] - total[start]) * down[start] + np.uint64(1_000_003 * n))) for n, c in zip(heads, cut, strict=True)])


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words within a text, by first word; False where the text ends before."""
    h, size = words.hash, len(words.hash)
    count = max(0, size - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[i : i + count]
    left = np.repeat(words.first[1:], np.diff(words.first))[:count]
    return mix(out), np.arange(count) + n <= left
