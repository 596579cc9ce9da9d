"""Document frequencies of all n-grams of a corpus, counted by 96-bit keys of the n-grams: their texts are looked up for the most frequent only."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.matching import FACTOR, pieces
from sievelight.operators import index
from sievelight.operators.clusters import training_ngrams

#: Tokens that are keyed at once.
TOKENS = 1 << 20
#: Keys are shuffled and counted in so many parts, each as a whole: bits of the key that choose the part.
PART_BITS = 12
#: Most frequent n-grams, with ties, whose texts are looked up by key; with more, the texts themselves are counted.
MOST_NAMED = 100_000
#: One document in so many is searched first for the texts of frequent n-grams.
FIRST_OF = 64


def keys_of(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every n consecutive tokens of one list: the list, the place of the first token in it, and a key of 64 and 32 bits."""
    flat = lists.flatten().cast(pa.string()).dictionary_encode()
    words = b"".join(blake2b(w.encode(), digest_size=16).digest() for w in flat.dictionary.to_pylist())
    hashes, ids = np.frombuffer(words, np.uint64).reshape(-1, 2), flat.indices.to_numpy()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    fit = np.maximum(sizes - n + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), fit)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(fit) - fit, fit)
    at = place + (np.cumsum(sizes) - sizes)[owner]
    key = []
    for side in (0, 1):
        code, word = np.zeros(len(at), np.uint64), hashes[:, side][ids] if len(ids) else np.zeros(0, np.uint64)
        for i in range(n):
            code = (code ^ word[at + i]) * FACTOR
            code ^= code >> np.uint64(31)
        key.append(code)
    return owner, place, key[0], (key[1] >> np.uint64(32)).astype(np.uint32)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, each the bytes of the array between two ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _dealt(tokens: DataFrame, n: int) -> DataFrame:
    """part, and the keys (high and low) of the n-grams of a piece of the corpus in that part, one for each document that has the n-gram; equal parts lie together."""
    schema = pa.schema([("part", pa.int32()), ("high", pa.binary()), ("low", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, 0, TOKENS)):
            owner, _, high, low = keys_of(batch.column(0), n)
            order = np.lexsort((low, high, owner))
            order = order[firsts(owner[order], high[order], low[order])]
            order = order[np.argsort(high[order])]
            high, low = high[order], low[order]
            part = (high >> np.uint64(64 - PART_BITS)).astype(np.int32)
            begin = np.flatnonzero(firsts(part)) if len(part) else np.zeros(0, np.int64)
            ends = np.append(begin, len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part[begin]), _blobs(high, ends), _blobs(low, ends)], schema=schema)

    return tokens.select("tokens").mapInArrow(deal, "part int, high binary, low binary").repartition("part").sortWithinPartitions("part")


def _counted(dealt: DataFrame, most: int | None) -> DataFrame:
    """high, low and df of each part's keys that are among its ``most`` frequent ones, with ties; without ``most``: df, and how many keys have it."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("df", pa.int64())] if most else [("df", pa.int64()), ("n", pa.int64())])

    def count(high: list[bytes], low: list[bytes]) -> pa.RecordBatch:
        a, b = np.frombuffer(b"".join(high), np.uint64), np.frombuffer(b"".join(low), np.uint32)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        begin = np.flatnonzero(firsts(a, b))
        df = np.diff(np.append(begin, len(a)))
        if not most:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.unique(df, return_counts=True)], schema=schema)
        begin, df = (x[df >= np.partition(df, -most)[-most]] for x in (begin, df)) if len(df) > most else (begin, df)
        return pa.RecordBatch.from_arrays([pa.array(a[begin].view(np.int64)), pa.array(b[begin].astype(np.int64)), pa.array(df, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, high, low = None, [], []
        for batch in batches:
            for p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part and high:
                    yield count(high, low)
                    high, low = [], []
                part = p
                high.append(a)
                low.append(b)
        if high:
            yield count(high, low)

    return dealt.mapInArrow(run, "high long, low long, df long" if most else "df long, n long")


def _texts(tokens: DataFrame, n: int, keys: list[tuple[int, int]]) -> dict[tuple[int, int], str]:
    """The n-grams of some keys, of those that occur in the documents."""
    sent = tokens.sparkSession.sparkContext.broadcast((np.array(sorted(k[0] for k in keys), np.int64).view(np.uint64), frozenset(keys)))
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("ngram", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, exact = sent.value
        wanted, seen = np.sort(wanted), set()
        for batch in (piece for whole in batches for piece in pieces(whole, 0, TOKENS)):
            lists = batch.column(0)
            owner, place, high, low = keys_of(lists, n)
            hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, high), len(wanted) - 1)] == high)
            rows = []
            for i, key in zip(hit.tolist(), zip(high[hit].view(np.int64).tolist(), low[hit].tolist(), strict=True), strict=True):
                if key in exact and key not in seen:
                    seen.add(key)
                    words = lists[int(owner[i])].values.slice(int(place[i]), n).to_pylist()
                    rows.append((*key, " ".join(map(str, words))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = tokens.select("tokens").mapInArrow(find, "high long, low long, ngram string").groupBy("high", "low").agg(F.min("ngram").alias("ngram"))
    return {(r["high"], r["low"]): r["ngram"] for r in found.collect()}


def one_row_each(docs: DataFrame) -> bool:
    """Whether every document has a row and an id of its own; else n-grams are counted by their texts."""
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()


def df_histogram(docs: DataFrame, tokens: DataFrame, n: int) -> DataFrame:
    """Number of n-grams by how many of the documents (``tokens`` are theirs) have them."""
    if not one_row_each(docs):
        return index.df_histogram(_by_text(tokens, n))
    return index.df_classes(_counted(_dealt(tokens, n), None), F.sum("n"))


def hot_ngrams(docs: DataFrame, tokens: DataFrame, n: int, limit: int = 100) -> DataFrame:
    """The n-grams that most documents have."""
    if not one_row_each(docs):
        return index.hot_ngrams(_by_text(tokens, n), limit)
    counted = _counted(_dealt(tokens, n), limit).persist(StorageLevel.MEMORY_AND_DISK)
    top = counted.select("df").orderBy(F.desc("df")).limit(limit).collect()
    least = top[-1]["df"] if top else 0
    dfs = {(r["high"], r["low"]): r["df"] for r in counted.where(F.col("df") >= least).limit(MOST_NAMED + 1).collect()}
    counted.unpersist()
    if len(dfs) > MOST_NAMED:
        return index.hot_ngrams(_by_text(tokens, n), limit)
    found: dict[tuple[int, int], str] = {}
    for searched in (tokens.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_OF)) == 0), tokens):
        if rest := [k for k in dfs if k not in found]:
            found |= _texts(searched, n, rest)
    return index.hot_ngrams(tokens.sparkSession.createDataFrame([(found[k], df) for k, df in dfs.items()], "ngram string, df long"), limit)


def _by_text(tokens: DataFrame, n: int) -> DataFrame:
    """ngram and df."""
    return training_ngrams(tokens, n).select("ngram", "doc_id").distinct().groupBy("ngram").agg(F.count("doc_id").alias("df"))
