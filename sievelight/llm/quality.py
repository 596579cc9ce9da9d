"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (of low quality) and 2 (good). One vector of hashed-text weights is
shared by all thresholds, which are kept in order: P(grade <= k) = sigmoid(threshold_k - score).
The fit takes a bounded sample of rated documents (``max_rated`` of them and ``max_bytes`` of text,
by hash of doc_id, the same in every run); every document is then scored on its whole text.

Cases: a null or empty text is scored by what an absence of words is worth; ratings with a null
are left out, and of several ratings of a document the worst counts; fewer than two grades among
the ratings give a model that rejects nothing; repeated rows are scored row by row and learned from
once; an empty table gives no rows; extra columns are ignored.

The features of a text's shape count capitals, digits, marks and some kinds of marks of their own
(bars, exclamation marks, ``*&#$%``). These are what the generated junk of the test tables is full
of, so figures on those tables say little about other junk; README has them without these features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.bytewords import ALNUM, NOT_SPACE, chunks, mix, split_words

BITS = 18
MAX_RATED = 8_000
MAX_BYTES = 64 << 20
#: Bytes of the word beginnings that are features besides whole words: inflected forms share them.
HEADS = (4, 5, 6)
#: Steps of descent that a small sample gets too.
LEAST_STEPS = 800
#: Steps of a count or a share of the text's shape.
STEPS = 16


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs, each once: hashed words and their beginnings, and steps of the text's shape."""
    n = len(ends) - 1
    w, *heads = split_words(data, ends, ALNUM, heads=HEADS)
    owner = np.repeat(np.arange(n), np.diff(w.first))
    tokens = split_words(data, ends, NOT_SPACE, hashed=False)
    size = np.maximum(np.diff(ends), 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends[1:]] - total[ends[:-1]]

    own = owner.astype(np.uint64) << np.uint64(BITS)
    pairs = np.unique(own | w.hash >> np.uint64(64 - BITS))
    distinct = np.bincount((pairs >> np.uint64(BITS)).astype(np.int64), minlength=n)
    pairs = np.unique(np.concatenate([pairs, *[own | h.hash >> np.uint64(64 - BITS) for h in heads]]))
    again = np.bincount(owner[1:][(w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    words = np.diff(w.first)
    marks = [(data >= 65) & (data <= 90), ~ALNUM[data] & NOT_SPACE[data], (data >= 48) & (data <= 57), data == 124, (data == 42) | (data == 38) | (data == 36) | (data == 37) | (data == 35), data == 33]
    each = np.maximum(np.diff(tokens.first), 1)
    shape = [10 * distinct / np.maximum(words, 1), np.log2(words + 1), size / each, np.log2(again + 1), 20 * again / np.maximum(words, 1)]
    for n_marked in map(count, marks):
        shape += [np.log2(n_marked + 1), 12 * n_marked / each]
    rows, codes = [(pairs >> np.uint64(BITS)).astype(np.int64)], [(pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)]
    for i, x in enumerate(shape):  # a feature for every step up to the value
        steps = np.minimum(np.ceil(x), STEPS).astype(np.int64)
        at = np.repeat(np.arange(n), steps)
        step = np.arange(len(at)) - np.repeat(np.cumsum(steps) - steps, steps)
        rows.append(at)
        codes.append((mix(step.astype(np.uint64) + np.uint64(1000 * (i + 1))) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(codes)


@dataclass
class Ordinal:
    weights: np.ndarray  # float32, 2 ** BITS
    thresholds: np.ndarray  # in order

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        row, code = features(data, ends)
        return np.bincount(row, self.weights[code].astype(np.float64), minlength=len(ends) - 1)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, *, levels: int = 3, epochs: int = 15, rate: float = 0.1, sparse: float = 30.0, decay: float = 1.0, seed: int = 5) -> Ordinal:
    """Follow the regularised leader on the cumulative-link likelihood.

    A weight stays 0 until its summed gradient exceeds ``sparse``: words that a few rated texts
    share by chance get none. Thresholds' gaps are exponentials, so they stay in order.
    """
    weights, summed, squares = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    if len(set(grades.tolist())) < 2:
        return Ordinal(weights.astype(np.float32), np.full(levels - 1, -60.0))
    lowest, gaps = -2.0, np.zeros(levels - 2)
    squares_t = np.ones(levels - 1)
    rng = np.random.Generator(np.random.PCG64(seed))
    lengths = np.array([len(r) for r in rows])
    batch = min(256, max(16, len(rows) // 40))
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(rows)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            code, owner = np.concatenate([rows[i] for i in own]), np.repeat(np.arange(len(own)), lengths[own])
            score = np.bincount(owner, weights[code], minlength=len(own))
            t = np.concatenate([[-np.inf], lowest + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), [np.inf]])
            y = grades[own]
            s = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            hi, lo = s(t[y + 1] - score), s(t[y] - score)
            d_hi, d_lo = hi * (1 - hi) * np.isfinite(t[y + 1]), lo * (1 - lo) * np.isfinite(t[y])
            p = np.maximum(hi - lo, 1e-9)
            slope = (d_hi - d_lo) / p  # of -log p by score
            seen = np.zeros(1 << BITS, bool)
            seen[code] = True
            used = np.flatnonzero(seen)
            g = np.bincount(code, slope[owner], minlength=1 << BITS)[used]
            after = squares[used] + g * g
            summed[used] += g - (np.sqrt(after) - np.sqrt(squares[used])) / rate * weights[used]
            squares[used] = after
            excess = np.sign(summed[used]) * np.maximum(np.abs(summed[used]) - sparse, 0)
            weights[used] = -excess / ((1 + np.sqrt(after)) / rate + decay)
            by_t = np.zeros(levels + 1)
            np.add.at(by_t, y + 1, -d_hi / p)
            np.add.at(by_t, y, d_lo / p)
            by_t = by_t[1:-1]
            g_t = np.concatenate([[by_t.sum()], [by_t[k + 1 :].sum() * np.exp(gaps[k]) for k in range(levels - 2)]])
            squares_t += g_t * g_t
            move = 0.3 * g_t / np.sqrt(squares_t)
            lowest, gaps = lowest - move[0], gaps - move[1:]
    return Ordinal(weights.astype(np.float32), lowest + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def rated_sample(docs: DataFrame, labels: DataFrame, max_rated: int, max_bytes: int = MAX_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of up to ``max_rated`` rated documents of up to ``max_bytes`` together, on the driver."""
    worst = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    chosen = worst.select("doc_id", grade.alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    # at most max_rated rows are broadcast; documents that share an id may be more, and are cut off here
    rated = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(chosen), "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id", "text_hash"]
    first = rated.groupBy("doc_id", "text_hash").agg(F.max(F.octet_length("text")).alias("n")).orderBy(*order).limit(max_rated)
    fits = first.withColumn("total", F.sum("n").over(Window.orderBy(*order))).where(F.coalesce("total", F.lit(0)) <= max_bytes).select("doc_id", "text_hash")
    given = rated.join(F.broadcast(fits), ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "grade").agg(F.first("text").alias("text")).select("doc_id", "grade", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in chunks(batch.column(2)):
                row, code = features(data, ends)
                order = np.argsort(row, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(end - first + 1)), pa.int32()), pa.array(code[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), batch.column(1).slice(first, end - first).cast(pa.int32()), lists], ["doc_id", "grade", "codes"])

    found = given.mapInArrow(extract, "doc_id long, grade int, codes array<int>").toArrow()
    if not len(found):
        return [], np.zeros(0, np.int64)
    found = found.combine_chunks().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    codes = found.column("codes").combine_chunks()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    values, offsets = codes.values.to_numpy(), codes.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], found.column("grade").to_numpy().astype(np.int64)


def train_quality(docs: DataFrame, labels: DataFrame, *, max_rated: int = MAX_RATED) -> Ordinal:
    return fit(*rated_sample(docs, labels, max_rated))


def score_quality(docs: DataFrame, model: Ordinal, *, least: float = 0.6, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score, expected_grade, p_acceptable (above toxic), p_good (above low) and kept: p_good is at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "score", "expected_grade", "p_acceptable", "p_good", "kept"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in chunks(batch.column(1)):
                score = sent.value.score(data, ends)
                tails = sent.value.tails(score)
                rest = [c.slice(first, end - first) for c in batch.columns[2:]]
                values = [pa.array(x) for x in (score, tails.sum(1), tails[:, 0], tails[:, -1], tails[:, -1] >= least)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), *values, *rest], [*names, *batch.schema.names[2:]])

    rest = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest)
    schema = "doc_id long, score double, expected_grade double, p_acceptable double, p_good double, kept boolean"
    return given.mapInArrow(judge, schema + (f", rest {given.schema['rest'].dataType.simpleString()}" if rest else ""))


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.6, max_rated: int = MAX_RATED) -> DataFrame:
    """Documents that the classifier does not reject, with their columns."""
    scored = score_quality(docs, train_quality(docs, labels, max_rated=max_rated), least=least, carry=docs.columns)
    return scored.where("kept").select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
