"""MinHash near-duplicates by SetSketch registers.

A document's set is its distinct word shingles. Each of its registers keeps, on an exponential
scale and truncated, the least exponential hash over the set; registers merge by maximum and are
equal with about the probability of the sets' Jaccard similarity. Bands of registers give
candidate pairs, their similarity is estimated jointly by likelihood, and what is not clearly
below the threshold is confirmed on the full sets.

Equal sets are one class from the start. In a bucket every class is compared with a hub only;
classes that a component already holds together are not compared again, another hub follows, and
at last every pair of classes of one bucket that is still in different components is compared, in
blocks: by registers, then by the hashes of whole sets. A block returns the links that join its
components, not all pairs, and these are confirmed on the texts.
Components spread by labels in tables; nothing of them goes to the driver.

Cases: a null text, or one without words, has an empty set and is linked with nothing; with
fewer words than a shingle the whole sequence is one shingle; rows that share a doc_id are
documents of their own, and so are rows with a null doc_id, which count last; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.bytewords import LOWER, NOT_SPACE, chunks, mix, ngrams, split_words
from sievelight.llm.scratch import Scratch

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: Base and rate of the registers' scale, and the largest register.
SCALE, RATE, TOP = 1.02, 20.0, 2_047
#: A pair whose estimate is this far below the threshold is dropped unread: over five standard errors.
SLACK = 0.13
#: Candidate classes (of 40 bytes) up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Rounds of comparing with hubs before all that is left is compared, and classes of one block there.
HUB_ROUNDS = 2
BLOCK_ROWS = 512

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_ROW = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def registers(least: np.ndarray) -> np.ndarray:
    """Registers of the least 32-bit hashes: those as uniform numbers, made exponential, on the scale."""
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(SCALE)), 0, TOP).astype(np.int16)


def least_hashes(shingles: np.ndarray, buffer: np.ndarray) -> np.ndarray:
    low, out = shingles.astype(np.uint32), np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), len(buffer)):
        part = low[at : at + len(buffer)]
        own = buffer[: len(part)]
        np.multiply(part[:, None], _A, out=own)
        own += _B
        np.minimum(out, own.min(0), out=out)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of register rows of sets of known sizes, by the greatest joint likelihood of greater, smaller and equal registers."""
    more, fewer = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - fewer
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)
    above, below = p(u - v * grid), p(v - u * grid)
    safe = lambda x: np.log(np.maximum(x, 1e-12))
    return np.take_along_axis(grid, (more * safe(above) + fewer * safe(below) + same * safe(1 - above - below)).argmax(1)[:, None], 1)[:, 0]


def document_shingles(data: np.ndarray, ends: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, in order."""
    w = split_words(data, ends, NOT_SPACE)
    grams, _ = ngrams(w, size)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            h = np.uint64(b - a)
            for x in w.hash[a:b]:
                h = mix(np.array([h * np.uint64(3) ^ x]))[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def set_digest(shingles: np.ndarray) -> bytes:
    return b"".join(int(mix(shingles ^ np.uint64(k)).sum(dtype=np.uint64)).to_bytes(8, "big") for k in (0x1234567, 0x7654321F0F0F))


def sketch_documents(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cls (digest of the set), regs and bands (a bucket key for each)."""
    schema = "doc_id long, text_hash long, n_shingles long, cls binary, regs binary, bands array<long>"

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = np.empty((512, REGISTERS), np.uint32)
        for batch in batches:
            for first, end, data, ends in chunks(batch.column(2)):
                least, sizes, digests = np.zeros((end - first, REGISTERS), np.uint32), [], []
                with np.errstate(over="ignore"):
                    for i, shingles in enumerate(document_shingles(data, ends, size)):
                        least[i] = least_hashes(shingles, buffer)
                        sizes.append(len(shingles))
                        digests.append(set_digest(shingles))
                regs = registers(least)
                bands = mix((regs.astype(np.uint64).reshape(-1, BANDS, ROWS) * _BAND).sum(2, dtype=np.uint64) + _ROW)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), keys],
                    ["doc_id", "text_hash", "n_shingles", "cls", "regs", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(sketch, schema)


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that may reach the threshold, by sizes and by likelihood."""
    side = lambda x: sketches.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")).hint("merge")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                regs = [np.frombuffer(b"".join(part.column(k).to_pylist()), np.int16).reshape(-1, REGISTERS) for k in (2, 4)]
                found = estimate(*regs, *[part.column(k).to_numpy().astype(float) for k in (3, 5)])
                yield pa.RecordBatch.from_arrays(list(part.columns[:2]), ["a", "b"]).filter(pa.array(found >= percent / 100 - SLACK))

    return joined.select("a", "b", "regs_a", "n_a", "regs_b", "n_b").mapInArrow(judge, "a long, b long")


def shingle_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().translate(LOWER.tobytes()).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(size)], strict=False))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs that reach the threshold on their full sets."""
    side = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            keep = []
            for b, text_a, text_b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if last[0] != b:  # rows come in the order of b
                    last = (b, shingle_set(text_b.as_py(), size))
                one, two = shingle_set(text_a.as_py(), size), last[1]
                both = len(one & two)
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(judge, "a long, b long")


def _dealt(mixed: DataFrame, rows_each: int) -> tuple[DataFrame, DataFrame]:
    """Members of each bucket outside its largest component, dealt into blocks (side 0), and every member once for each block (side 1)."""
    counts = mixed.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "label")).alias("big"), F.sum("k").alias("n"))
    sized = counts.select("key", F.col("big.label").alias("big"), F.ceil((F.col("n") - F.col("big.k")) / rows_each).cast("int").alias("blocks")).where("blocks > 0")
    rows = mixed.join(sized, "key")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    left = rows.where("label <> big").select("key", own.alias("block"), F.lit(0).cast("byte").alias("side"), "band", "cid", "label", "big")
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).cast("byte").alias("side"), "band", "cid", "label", "big")
    return left, right


class Members:
    """Classes of one bucket as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        at = lambda name: batch.column(batch.schema.get_field_index(name))
        self.band, self.cid, self.label, self.big, self.size = (at(x).to_numpy() for x in ("band", "cid", "label", "big", "n_shingles"))
        self.regs = np.frombuffer(b"".join(at("regs").to_pylist()), np.int16).reshape(-1, REGISTERS)
        self.shingles = self.owner = None
        if batch.schema.get_field_index("shingles") >= 0:
            each = [np.frombuffer(x, np.uint64) for x in at("shingles").to_pylist()]
            self.shingles, self.owner = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])


def open_pairs(x: Members, y: Members, percent: int) -> np.ndarray:
    """Which pairs are to be looked at here: of different components, of sizes that allow a link, and (where both are outside the largest component) once."""
    once = (y.label == y.big)[None, :] | (x.cid[:, None] < y.cid[None, :])
    sizes = 100 * np.minimum(x.size[:, None], y.size[None, :]) >= percent * np.maximum(x.size[:, None], y.size[None, :])
    return once & sizes & (x.label[:, None] != y.label[None, :])


def first_band_here(x: Members, y: Members, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs, those whose first common band is this bucket's: they are looked at in no other bucket."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 4_096):
        u, v = i[at : at + 4_096], j[at : at + 4_096]
        out[at : at + 4_096] = (x.regs[u] == y.regs[v]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == x.band[0]
    return out


def likely_members(x: Members, y: Members, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y that are in some pair whose estimate may reach the threshold."""
    i, j = np.nonzero(open_pairs(x, y, percent))
    here = first_band_here(x, y, i, j)
    i, j = i[here], j[here]
    found = [np.zeros(len(i), bool)]
    for at in range(0, len(i), 4_096):
        u, v = i[at : at + 4_096], j[at : at + 4_096]
        found.append(estimate(x.regs[u], y.regs[v], x.size[u].astype(float), y.size[v].astype(float)) >= percent / 100 - SLACK)
    found = np.concatenate(found[1:]) if len(i) else found[0]
    return np.unique(i[found]), np.unique(j[found])


def common_shingles(x: Members, y: Members) -> np.ndarray:
    """Sizes of all intersections of the sets of x with those of y, by looking up each shingle of y among those of x."""
    order = np.argsort(x.shingles, kind="stable")
    values, owner = x.shingles[order], x.owner[order]
    low = np.searchsorted(values, y.shingles)
    n = np.searchsorted(values, y.shingles, "right") - low
    out, total, at = np.zeros(len(x.cid) * len(y.cid), np.int64), np.cumsum(n), 0
    while at < len(n):  # two million equal shingles at once
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 2_000_000, "right")))
        k = n[at:to]
        place = np.repeat(low[at:to] - np.cumsum(k) + k, k) + np.arange(k.sum())
        out += np.bincount(owner[place] * len(y.cid) + np.repeat(y.owner[at:to], k), minlength=len(out))
        at = to
    return out.reshape(len(x.cid), len(y.cid))


def joining_links(x: Members, y: Members, percent: int, root: dict[int, int]) -> list[tuple[int, int]]:
    """Links that join components which ``root`` (changed in place) has apart, one for each joining."""

    def top(label: int) -> int:
        while (up := root.get(label, label)) != label:
            root[label] = root.get(up, up)
            label = up
        return label

    of = lambda m: np.array([top(z) for z in m.label.tolist()])
    mine, theirs = of(x), of(y)
    asked = open_pairs(x, y, percent) & (mine[:, None] != theirs[None, :])
    i, j = np.nonzero(asked)
    here = first_band_here(x, y, i, j)
    i, j = i[here], j[here]
    if not len(i):
        return []
    both = common_shingles(x, y)[i, j]
    linked = 100 * both >= percent * (x.size[i] + y.size[j] - both)
    i, j, out = i[linked], j[linked], []
    while len(i):
        out.append((int(x.cid[i[0]]), int(y.cid[j[0]])))
        old, new = mine[i[0]], theirs[j[0]]
        root[int(old)] = int(new)
        mine[mine == old], theirs[theirs == old] = new, new
        apart = mine[i] != theirs[j]
        i, j = i[apart], j[apart]
    return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Members, pa.RecordBatch]]:
    """(key and block, members of the block, a slice of the bucket's members) of rows in the order of key, block and side."""
    group, held, block = None, [], None
    for batch in batches:
        key, part, side = (batch.column(i).to_numpy() for i in range(3))
        edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1, [len(key)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo and (key[lo], part[lo]) != group:
                group, held, block = (key[lo], part[lo]), [], None
            if hi > lo and side[lo] == 0:
                held.append(batch.slice(lo, hi - lo))
            elif hi > lo and held:
                block = block or Members(pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0])
                for at in range(lo, hi, 64):
                    yield group, block, batch.slice(at, min(64, hi - at))


def _block_links(mixed: DataFrame, known: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join what is left of the buckets, by comparing their classes in blocks.

    Registers first tell which classes have a likely partner. The sets of these then meet in the
    same way, as 64-bit hashes of their shingles: a block knows which of its components it has
    joined and returns one link for each joining, however many pairs are linked.
    """
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df: df.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "side")
    left, right = _dealt(mixed, BLOCK_ROWS)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, told = None, set()
        for key, x, part in _by_block(batches):
            if key != group:
                group, told = key, set()
            y = Members(part)
            i, j = likely_members(x, y, percent)
            new = {*x.cid[i].tolist(), *y.cid[j].tolist()} - told
            told |= new
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(new), pa.int64()), pa.array(sorted(new), pa.int64())], ["key", "cid"])

    sketched = deal(left.unionByName(right).join(known.select("cid", "n_shingles", "regs").hint("merge"), "cid").select("key", "block", "side", "band", "cid", "label", "big", "n_shingles", "regs"))
    open_ = scratch.save(sketched.mapInArrow(likely, "key long, cid long").distinct(), "open")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in chunks(batch.column(1)):
                with np.errstate(over="ignore"):
                    sets = [s.tobytes() for s in document_shingles(data, ends, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(sets, pa.binary())], ["cid", "shingles"])

    sets = scratch.save(texts.join(open_.select("cid").distinct(), "cid", "left_semi").select("cid", "text").mapInArrow(hashed, "cid long, shingles binary"), "sets")
    left, right = _dealt(mixed.join(open_, ["key", "cid"]), BLOCK_ROWS)
    whole = left.unionByName(right).join(known.select("cid", "n_shingles", "regs").hint("merge"), "cid").join(sets.hint("merge"), "cid")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, root = None, {}
        for key, x, part in _by_block(batches):
            if key != group:
                group, root = key, {}
            if found := joining_links(x, Members(part), percent, root):
                yield pa.RecordBatch.from_arrays([pa.array([f(z) for z in found], pa.int64()) for f in (min, max)], ["a", "b"])

    return deal(whole.select("key", "block", "side", "band", "cid", "label", "big", "n_shingles", "regs", "shingles")).mapInArrow(link, "a long, b long").distinct()


def spread_labels(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Least label of each component: ``labels`` (cid, label), where a label is the id of a node of the component, and ``edges`` (a, b)."""
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    while True:
        # every node takes the least label around it, and what that label's own node has
        near = both.join(labels.select(F.col("cid").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("cid")).agg(F.min("l").alias("near"))
        lower = scratch.save(labels.join(near, "cid", "left").select("cid", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")), "lower")
        jump = lower.select(F.col("cid").alias("c"), F.col("label").alias("beyond"))
        done = scratch.save(lower.join(jump, F.col("label") == F.col("c"), "left").select("cid", "old", F.coalesce("beyond", "label").alias("label")), "labels")
        changed = done.where("label <> old").limit(1).count()
        scratch.drop(lower)
        labels = done.select("cid", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept, one row per document."""
    return near_groups(docs, **options).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, *, scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id (null last), of equal ones that with the least hash of its text.

    Rows without words all stay. Of rows with one doc_id and text that stays, the least by its other columns (as JSON) does.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    groups = near_groups(docs, scratch=scratch, **options)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    firsts = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    keys = firsts.select("first.doc_id", "first.text_hash", F.lit(True).alias("one")).unionByName(groups.where("component IS NULL").select("doc_id", "text_hash", F.lit(False).alias("one")).distinct())
    keys = scratch.save(keys.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "one"), "keys")
    again = scratch.save(groups.where("component IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")), "again")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    here = lambda keys: F.col("doc.doc_id").cast("long").eqNullSafe(keys["kept_id"]) & (F.xxhash64("doc.text") == keys["kept_hash"])
    kept = given.join(keys, here(keys), "left_semi")
    if again.limit(1).count():  # rows that share an id and a text: few, or the corpus repeats itself
        place = Window.partitionBy("doc.doc_id", F.xxhash64("doc.text")).orderBy(F.to_json("doc"))
        repeated = kept.join(again, here(again), "left_semi").withColumn("copy", F.row_number().over(place)).where("copy = 1").select("doc")
        kept = kept.join(again, here(again), "left_anti").unionByName(repeated)
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def near_groups(docs: DataFrame, *, size: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and component (its key, null of a document without words), one row per document."""
    scratch = scratch or Scratch(docs.sparkSession, "near")
    sketches = scratch.save(sketch_documents(docs, size), "sketches")
    filled = sketches.where("n_shingles > 0")
    # a class: documents with equal sets; a null doc_id is never its name if another is there
    classes = scratch.save(filled.groupBy("cls").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = filled.select("doc_id", "cls", "n_shingles", "regs", "bands").join(classes.withColumnRenamed("cls", "c"), (F.col("c") == F.col("cls")) & F.col("rep").eqNullSafe(F.col("doc_id")), "left_semi").dropDuplicates(["cls"])
    firsts = scratch.save(firsts.withColumn("cid", F.monotonically_increasing_id()), "firsts")
    buckets = firsts.select("cid", F.posexplode("bands").alias("band", "key")).withColumn("band", F.col("band").cast("byte"))
    shared = scratch.save(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    members = scratch.save(buckets.join(shared, "key"), "members")
    nodes = members.select("cid").distinct()
    known = scratch.save(firsts.select("cid", "cls", F.col("doc_id").alias("rep"), "n_shingles", "regs").join(nodes, "cid", "left_semi"), "known")
    wanted = known.select("rep", F.col("cls").alias("want"), "cid")
    if known.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = scratch.save(_of_class(docs.select(F.col("doc_id").cast("long"), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))), size), "texts")
    labels = scratch.save(known.select("cid", F.col("cid").alias("label")), "labels")
    tested = None
    for turn in range(HUB_ROUNDS + 1):
        # buckets within one component are done with; written, so that joins have plain shuffles on both sides and a hot bucket is split
        labelled = members.join(labels, "cid")
        spread = scratch.save(labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), "cid", "label")).alias("hub")).where("least <> most").select("key", "hub"), "spread")
        mixed = scratch.save(labelled.join(spread, "key"), "mixed")
        members = mixed.select("key", "band", "cid")
        if turn < HUB_ROUNDS:
            pairs = mixed.where("label <> hub.label").select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct()
        else:
            pairs = _block_links(mixed.drop("hub"), known, texts, size, percent, scratch)
        if tested is not None and turn < HUB_ROUNDS:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        likely = scratch.save(_likely(pairs, known, percent), "likely") if turn < HUB_ROUNDS else pairs
        found = scratch.save(_confirmed(likely, texts, size, percent), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = spread_labels(labels, found, scratch)
    # null ids name a component only where it has no other
    linked = labels.join(known.select("cid", "cls", "rep"), "cid")
    least = scratch.save(linked.groupBy("label").agg(F.min("rep").alias("least_id")), "least")
    named = linked.join(least, "label").select(F.col("cls").alias("c"), "least_id", F.col("label").cast("string").alias("label"))
    ids = classes.join(named.hint("merge"), F.col("cls") == F.col("c"), "left").select("cls", F.coalesce("least_id", "rep").alias("component_id"), F.coalesce("label", F.hex("cls")).alias("component"))
    filled = sketches.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "cls").join(scratch.save(ids, "ids"), "cls").drop("cls")
    empty = sketches.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("string").alias("component"))
    return filled.unionByName(empty)


def _of_class(found: DataFrame, size: int) -> DataFrame:
    """Texts whose set has the wanted digest, one of each class."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in chunks(batch.column(1)):
                with np.errstate(over="ignore"):
                    got = [set_digest(s) for s in document_shingles(data, ends, size)]
                part = batch.slice(first, end - first)
                keep = [g == w for g, w in zip(got, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(1)], ["cid", "text"]).filter(pa.array(keep, pa.bool_()))

    return found.select("doc_id", "text", "want", "cid").mapInArrow(judge, "cid long, text string").dropDuplicates(["cid"])
