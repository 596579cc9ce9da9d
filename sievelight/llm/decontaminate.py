"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams scans training token windows.

Texts are lower-cased (A-Z only) and split into words; a window is ``n`` consecutive words of
an item, or the whole of a shorter item. Every window of every document is looked up by hash;
a hit is verified word by word. The benchmark goes out in blocks of a bounded size, so one
larger than a block costs more lookups, not more memory.

Cases: a null or empty text has no words and is never hit; a null item text adds no window; a
null item id marks words but is not listed; equal item ids are one item; repeated document rows
are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.bytewords import ALNUM, LOWER, chunks, ngrams, split_words

#: Bytes of item text in one broadcast block; its windows take about three times as much.
BLOCK_BYTES = 2_000_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, clean_text string"


class Block:
    """Windows of some items, by length: sorted hashes with the item and first word of each."""

    def __init__(self, items: list[tuple[int | None, str]], n: int):
        column = pa.array([text for _, text in items], pa.string())
        self.ids = [None if i is None else str(i) for i, _ in items]
        self.words: list[list[bytes]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for first, end, data, ends in chunks(column):
            raw, w = LOWER[data].tobytes(), split_words(data, ends, ALNUM)
            for i in range(first, end):
                a, b = int(w.first[i - first]), int(w.first[i - first + 1])
                self.words.append([raw[s:e] for s, e in zip(w.start[a:b], w.end[a:b], strict=True)])
            sizes = np.diff(w.first)
            for m in {min(n, int(x)) for x in sizes} - {0}:
                own = (sizes == m) if m < n else (sizes >= n)
                grams, whole = ngrams(w, m)
                item = np.repeat(np.arange(end - first), sizes)[: len(grams)]
                at = np.flatnonzero(whole & own[item])
                found.setdefault(m, []).append((grams[at], item[at] + first, at - w.first[item[at]]))
        self.tables = {}
        for m, parts in found.items():
            key, item, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            bits = max(16, min(24, int(np.ceil(np.log2(len(key) + 1))) + 6))
            seen = np.zeros(1 << bits, bool)
            seen[key >> np.uint64(64 - bits)] = True
            self.tables[m] = (key[order], item[order].astype(np.int32), pos[order].astype(np.int32), seen, np.uint64(64 - bits))

    def hits(self, w, raw: bytes) -> Iterator[tuple[int, int, list[str | None]]]:
        """(first word, length, item ids) of each verified window."""
        for m, (key, item, pos, seen, shift) in self.tables.items():
            grams, whole = ngrams(w, m)
            at = np.flatnonzero(seen[grams >> shift] & whole)
            lo = np.searchsorted(key, grams[at], "left")
            hi = np.searchsorted(key, grams[at], "right")
            for i in np.flatnonzero(hi > lo):
                p = int(at[i])
                own = [raw[s:e] for s, e in zip(w.start[p : p + m], w.end[p : p + m], strict=True)]
                if ids := [self.ids[item[k]] for k in range(lo[i], hi[i]) if self.words[item[k]][pos[k] : pos[k] + m] == own]:
                    yield p, m, ids


def blocks(items: DataFrame, n: int, block_bytes: int) -> Iterator[Block]:
    """The items in blocks, read one after another; an item is never cut."""
    rows, size = [], 0
    for row in items.toLocalIterator():
        rows.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_bytes:
            yield Block(rows, n)
            rows, size = [], 0
    if rows:
        yield Block(rows, n)


def scan_benchmark(docs: DataFrame, items: DataFrame, *, n: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """One row per document row: counts of words and hit words, items with hits, the hit spans (byte offsets) and the text without them.

    ``contaminated``: some word is hit, and hit words are at least ``percent`` of all.
    ``carry``: columns that come along in a struct ``rest``.
    """
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(b) for b in blocks(items.select(F.col(item_id_col), F.col(item_text_col)).where(F.col(item_text_col).isNotNull()), n, block_bytes)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in chunks(batch.column(1)):
                yield part(batch.slice(first, end - first), data, ends)

    def part(rows: pa.RecordBatch, data: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        ids, texts = rows.column(0), rows.column(1)
        w = split_words(data, ends, ALNUM)
        raw = LOWER[data].tobytes()
        cover = np.zeros(len(w.start) + 1, np.int32)
        listed: dict[int, set[str]] = {}
        doc_of = np.repeat(np.arange(len(ids)), np.diff(w.first))
        for b in sent:
            for p, m, found in b.value.hits(w, raw):
                cover[p] += 1
                cover[p + m] -= 1
                listed.setdefault(int(doc_of[p]), set()).update(x for x in found if x is not None)
            if len(sent) > 1:
                b.__dict__.pop("_value", None)  # one block in memory at a time
        hit = np.cumsum(cover[:-1]) > 0
        total = np.diff(w.first)
        hits = np.bincount(doc_of[hit], minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
        spans: list[list[dict]] = [[] for _ in range(len(ids))]
        clean = texts
        if hit.any():
            opens = hit.copy()
            opens[1:] &= ~hit[:-1] | (doc_of[1:] != doc_of[:-1])
            closes = hit.copy()
            closes[:-1] &= ~hit[1:] | (doc_of[1:] != doc_of[:-1])
            for a, b in zip(np.flatnonzero(opens), np.flatnonzero(closes), strict=True):
                base = ends[doc_of[a]]
                spans[doc_of[a]].append({"start": int(w.start[a] - base), "end": int(w.end[b] - base)})
            out = texts.to_pylist()
            for i in np.flatnonzero(hits):
                text, kept, last = data[ends[i] : ends[i + 1]].tobytes(), [], 0
                for s in spans[i]:
                    kept.append(text[last : s["start"]])
                    last = s["end"]
                out[i] = b"".join([*kept, text[last:]]).decode()
            clean = pa.array(out, pa.string())
        named = [hashlib.sha256(",".join(sorted(listed.get(i, ()))).encode()).hexdigest() for i in range(len(ids))]
        return pa.RecordBatch.from_arrays(
            [
                ids.cast(pa.int64()), pa.array(total, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(listed.get(i, ())) for i in range(len(ids))], pa.int64()), pa.array(named),
                pa.array((hits > 0) & (100 * hits >= percent * total)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), clean.cast(pa.string()), *rows.columns[2:],
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "clean_text", *rows.schema.names[2:]],
        )

    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest)
    schema = f"{SCHEMA}, rest {given.schema['rest'].dataType.simpleString()}" if rest else SCHEMA
    return given.mapInArrow(judge, schema)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Drop contaminated documents and cut the hit spans out of the others; columns as in ``docs``, which need doc_id and text."""
    own = docs.columns
    judged = scan_benchmark(docs, items, carry=[c for c in own if c != "text"], **options).where("not contaminated")
    return judged.select(*[F.col("clean_text").alias(c) if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in own])
