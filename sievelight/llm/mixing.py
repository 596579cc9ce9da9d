"""Mixing sources to target weights.

Documents are dealt by hash into pools, one for each output shard. In a pool each source's words
are packed into blocks of a fixed length. The shard's slots draw their sources from a multinomial:
a source has the whole part of its expected slots, and what is left is drawn by the parts after
the point, so that the shards together meet the targets. Slot ``j`` of a source in a shard is
block ``perm(j mod blocks)`` of a pseudorandom permutation that differs from source to source, shard
to shard and epoch to epoch, and slots join blocks by that index inside the shard. The texts go
through one shuffle, and the shard that they go to writes them.

Cases: a null text has no words and is never taken; a null source is a source of its own, after
all others; a source without words has target 0; repeated rows are documents of their own, which
share what was taken of them evenly; a pool that grows beyond ``CUT`` times its size is cut into
several shards; an empty table gives an empty mix. The number of sources must fit the driver
(``MAX_SOURCES``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 100_000
#: Slots of a shard on average, and times that at which a pool is cut.
SHARD_SLOTS = 1 << 14
CUT = 4
MIXED = "shard long, slot int, source_no int, source string, epoch int, block int, text string, parts array<struct<doc_id:long,digest:long,count:int>>"


def source_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Targets that share the whole size by weight; one above ``cap`` times its own size stops there, and the others share its excess."""
    left, target, open_ = float(sum(sizes)), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        for i in over or open_:
            target[i] = cap * sizes[i] if over else share[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)] if over else []
    return target


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index under a pseudorandom permutation of 0..n-1: four Feistel rounds, walked until inside."""
    bits = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, b, m, k = out[todo], bits[todo], mask[todo], key[todo]
        hi, lo = x >> b, x & m
        for r in range(4):
            f = (lo + k + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            hi, lo = lo, hi ^ (f & m)
        out[todo] = (hi << b) | lo
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def residual_draws(expected: np.ndarray, most: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Slots of each source in a shard, given those expected: their whole parts, and a multinomial draw of the rest by the parts after the point."""
    sure = np.floor(expected + 1e-9).astype(np.int64)
    rest = np.maximum(expected - sure, 0)
    room = int(np.floor(rest.sum() + rng.random()))
    drawn = rng.multinomial(room, rest / rest.sum()) if room else np.zeros(len(sure), np.int64)
    return np.minimum(sure + drawn, most)


def default_weights(n: int) -> list[float]:
    return [float(i % 3 + 1) for i in range(n)]


def doc_sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("digest"))


def source_stats(sized: DataFrame, *, cap: float, weights) -> pd.DataFrame:
    """source_no, source, source_size and target of every source, in order of code points, null last."""
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).toPandas()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = [None if x is None or x != x else x for x in stats["source"]]
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    sizes = [int(stats["source_size"].iloc[i]) for i in order]
    return pd.DataFrame({"source_no": np.arange(len(order)), "source": pd.Series([names[i] for i in order], dtype=object), "source_size": sizes, "target": source_targets(sizes, weights(len(sizes)), cap)})


class Shard:
    """The documents of one shard, as they come, and its slots."""

    def __init__(self, number: int):
        self.number, self.words, self.docs = number, 0, []

    def add(self, source: int, doc_id: int | None, digest: int, text: bytes) -> None:
        words = text.split()
        self.docs.append((source, doc_id, digest, words))
        self.words += len(words)

    def slots(self, ratio: np.ndarray, block_words: int, cap: float, seed: int) -> Iterator[tuple]:
        """(slot, source, epoch, block, text, parts): the shard's sources in turn by a random order of all its slots."""
        streams: dict[int, list] = {}
        for doc in self.docs:
            streams.setdefault(doc[0], []).append(doc)
        sources = np.array(sorted(streams), np.int64)
        size = np.array([sum(len(d[3]) for d in streams[i]) for i in sources.tolist()], np.int64)
        blocks = -(-size // block_words)
        rng = np.random.Generator(np.random.PCG64([seed, self.number]))
        drawn = residual_draws(ratio[sources] * blocks, (cap * blocks).astype(np.int64), rng) if len(sources) else blocks
        of = np.repeat(np.arange(len(sources)), drawn)
        j = np.arange(len(of)) - np.repeat(np.cumsum(drawn) - drawn, drawn)
        epoch = j // np.maximum(blocks[of], 1)
        own = np.full(len(of), self.number * 0xD6E8FEB86659FD93 & (1 << 64) - 1, np.uint64)
        key = (sources[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (epoch.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ own ^ np.uint64(seed)
        block = permuted(j % np.maximum(blocks[of], 1), blocks[of], key) if len(of) else j
        packed = {k: self._packed(streams[i], block_words) for k, i in enumerate(sources.tolist())}
        for slot, at in enumerate(rng.permutation(len(of)).tolist()):
            text, parts = packed[of[at]][block[at]]
            yield slot, int(sources[of[at]]), int(epoch[at]), int(block[at]), text, parts

    @staticmethod
    def _packed(docs: list, block_words: int) -> list[tuple[str, list]]:
        """The words of documents in blocks of ``block_words``, with what each document has in it."""
        out, words, parts = [], [], []
        for _, doc_id, digest, own in docs:
            at = 0
            while at < len(own):
                n = min(block_words - len(words), len(own) - at)
                words += own[at : at + n]
                parts.append((doc_id, digest, n))
                at += n
                if len(words) == block_words:
                    out.append((b" ".join(words).decode(), parts))
                    words, parts = [], []
        return [*out, (b" ".join(words).decode(), parts)] if words else out


def _blocks(docs: DataFrame, sized: DataFrame, stats: pd.DataFrame, *, block_words: int, cap: float, seed: int, shard_slots: int) -> DataFrame:
    """The mix: one row per slot, with the words and what each document has of them."""
    spark = docs.sparkSession
    total = int(stats["source_size"].sum())
    pools = max(1, -(-total // (shard_slots * block_words)))
    lookup = spark.createDataFrame([(int(r.source_no), r.source) for r in stats.itertuples()], "source_no int, name string")
    sent = spark.sparkContext.broadcast(([r.source for r in stats.itertuples()], np.array([t / n if n else 0.0 for t, n in zip(stats["target"], stats["source_size"], strict=True)])))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", F.xxhash64("text").alias("digest")).where("text IS NOT NULL")
    # the sources were counted: never more than MAX_SOURCES rows
    given = given.join(F.broadcast(lookup), F.col("source").eqNullSafe(F.col("name")))
    given = given.select(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(pools)).alias("pool"), F.xxhash64("digest", "doc_id", F.lit(seed)).alias("turn"), "doc_id", "source_no", "digest", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ratio = sent.value
        pool, shard, cuts = None, None, 0
        for batch in batches:
            texts = batch.column(5).cast(pa.binary())
            for i, (p, doc_id, source, digest) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
                if shard is not None and (p != pool or shard.words >= CUT * shard_slots * block_words):
                    yield from rows(shard, names, ratio)
                    cuts, shard = (cuts + 1 if p == pool else 0), None
                if shard is None:
                    pool, shard = p, Shard(p + cuts * pools)
                shard.add(source, doc_id, digest, texts[i].as_py())
        if shard is not None:
            yield from rows(shard, names, ratio)

    def rows(shard: Shard, names: list, ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for x in shard.slots(ratio, block_words, cap, seed):
            held.append(x)
            if len(held) == 8_192:
                yield pack(shard.number, held, names)
                held = []
        if held:
            yield pack(shard.number, held, names)

    def pack(number: int, held: list[tuple], names: list) -> pa.RecordBatch:
        slot, source, epoch, block, text, each = zip(*held, strict=True)
        flat = [p for x in each for p in x]
        struct = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.int64()), pa.array([p[2] for p in flat], pa.int32())], ["doc_id", "digest", "count"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in each])]), pa.int32()), struct)
        i32 = lambda x: pa.array(x, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([number] * len(held), pa.int64()), i32(slot), i32(source), pa.array([names[k] for k in source], pa.string()), i32(epoch), i32(block), pa.array(text, pa.string()), lists], ["shard", "slot", "source_no", "source", "epoch", "block", "text", "parts"])

    return given.repartition(parts, "pool").sortWithinPartitions("pool", "turn", "doc_id", "source_no").mapInArrow(mix, MIXED)


def mix_counts(docs: DataFrame, *, block_words: int = 32, cap: float = 3.0, seed: int = 17, weights=default_weights, shard_slots: int = SHARD_SLOTS, scratch: Scratch | None = None) -> DataFrame:
    """Write the mix; one row per document: size, source_size, target (of its source, in words) and taken (words of it in what was written)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    sized = scratch.save(doc_sizes(docs), "sizes")
    stats = source_stats(sized, cap=cap, weights=weights)
    written = scratch.save(_blocks(docs, sized, stats, block_words=block_words, cap=cap, seed=seed, shard_slots=shard_slots), "mix")
    taken = written.select("source_no", F.explode("parts").alias("part")).groupBy(F.col("source_no").alias("s"), F.col("part.doc_id").alias("i"), F.col("part.digest").alias("g")).agg(F.sum("part.count").alias("all_taken"))
    lookup = spark.createDataFrame([(int(r.source_no), r.source, int(r.source_size), float(r.target)) for r in stats.itertuples()], "source_no int, name string, source_size long, target double")
    # repeated rows are one here, and are told apart again below
    groups = sized.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("copies")).join(F.broadcast(lookup), F.col("source").eqNullSafe(F.col("name")))
    joined = groups.join(taken.hint("merge"), (F.col("s") == F.col("source_no")) & F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("digest")), "left")
    each = joined.withColumn("all_taken", F.coalesce("all_taken", F.lit(0))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    own = F.floor(F.col("all_taken") / F.col("copies")) + F.when(F.col("copy") <= F.col("all_taken") % F.col("copies"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", own.cast("long").alias("taken"))


def mix_blocks(docs: DataFrame, *, block_words: int = 32, cap: float = 3.0, seed: int = 17, weights=default_weights, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself: shard, slot, source, epoch, block and the block's words, one row per slot."""
    sized = doc_sizes(docs)
    stats = source_stats(sized, cap=cap, weights=weights)
    return _blocks(docs, sized, stats, block_words=block_words, cap=cap, seed=seed, shard_slots=shard_slots).select("shard", "slot", "source", "epoch", "block", "text")
