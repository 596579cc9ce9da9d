"""Matching token n-grams against a known set, a column of token lists at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Tokens, or bytes of text, that are worked on at once in Python, whatever the size of an Arrow batch.
PIECE = 1 << 18


def bounds(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, in order, whose sizes sum to at most ``most``; a larger row is a range of its own."""
    ends, first = np.cumsum(sizes), 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, end
        first = end


def pieces(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded size: by the number of elements of a list column."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy()
    for first, end in bounds(sizes, most or PIECE):
        yield batch.slice(first, end - first)


def _codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of every n consecutive token numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for i in range(n):
        out = (out ^ ids[i : i + len(out)].astype(np.uint64)) * FACTOR
        out ^= out >> np.uint64(31)
    return out


@dataclass
class NgramSet:
    """Tokens that occur in the set's n-grams, and the codes of these in order."""

    vocabulary: pa.Array
    codes: np.ndarray
    n: int

    @staticmethod
    def of(lists: pa.ListArray, n: int) -> NgramSet:
        """All n-grams of token lists."""
        vocabulary = pc.unique(lists.flatten())
        made = NgramSet(vocabulary, np.zeros(0, np.uint64), n)
        codes, place, _ = made._places(lists)
        made.codes = np.unique(codes[place])
        return made

    def _places(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes at every token, the places where n known tokens of one list begin, and where each list begins."""
        ids = pc.fill_null(pc.index_in(lists.flatten(), self.vocabulary), -1).to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())])
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        count = max(0, len(ids) - self.n + 1)
        place = np.flatnonzero(unknown[self.n : self.n + count] == unknown[:count])
        # few places are left; the list that each is in ends after its n tokens
        place = place[place + self.n <= ends[np.searchsorted(ends, place, "right")]]
        return _codes(ids, self.n), place, ends

    def find(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(list, position in it) of n-grams whose code is in the set."""
        codes, place, ends = self._places(lists)
        if not len(self.codes) or not len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = codes[place]
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        place = place[self.codes[at] == own]
        owner = np.searchsorted(ends, place, "right") - 1
        return owner, place - ends[owner]
