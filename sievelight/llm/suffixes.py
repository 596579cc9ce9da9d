"""Suffix-array dedup: bytes inside strings that start anywhere else too, across documents, are removed.

A string of ``length`` bytes holds an anchor: of the hashes of its inner ``gram``-byte strings the
least, the first of equal ones. Equal strings have it at the same place, so suffixes need only be
compared where anchors are equal, which is a hundredth of all. Anchors whose whole surroundings
recur, told by a 128-bit cryptographic digest of their bytes, are settled by counting. The
surroundings of the others, one of each kind, are sorted as suffixes, forwards and backwards: a
mergesort whose comparisons find the common extension by binary search over prefix polynomial
hashes. Common prefixes of neighbours give, for every offset, the classes of equal strings; what
is found is verified byte by byte. The offsets of a group that is too large for one task are
halved, again and again: strings at either half of them have a longer core in common, and by the
core the group falls apart.

Cases: a null text is empty; a text shorter than ``length`` loses nothing; repeated rows are
documents of their own, and so is a row with a null doc_id; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.bytewords import BYTE_CODE, chunks, mix, powers
from sievelight.llm.scratch import Scratch

SEGMENT = 1 << 18
#: Bits of an anchor's place in the key that orders hashes and places; the rest are the hash's.
PLACE = np.uint64(23)
#: Kinds of surroundings of one anchor up to which they are sorted at once, and rows that are sorted at once besides.
GROUP_ROWS = 8_000
BATCH_ROWS = 2_000


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte codes by powers, and the inverse powers: (sum[j] - sum[i]) * inverse[i] is the hash of data[i:j]."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(BYTE_CODE[data], up[: len(data)], out=total[1:])
    np.cumsum(total, out=total)
    return total, down


def digest(raw: bytes, *place: int) -> bytes:
    """128 bits of BLAKE2 of some bytes and of where they stand."""
    return hashlib.blake2b(raw, digest_size=16, salt=b"".join(p.to_bytes(4, "little") for p in place)).digest()


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of texts that lie end to end, the hashes of their grams, and digests of their surroundings (two columns)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    n, span = len(data), length - gram + 1
    if n < length:
        return none
    total, down = prefix_hashes(data)
    with np.errstate(over="ignore"):
        grams = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    sizes = np.diff(ends)
    valid = np.zeros(n - length + 1, bool)
    for a, b in zip(ends[:-1][sizes >= length], ends[1:][sizes >= length], strict=True):
        valid[a : b - length + 1] = True
    chosen = np.zeros(len(grams), bool)
    step = 1 << int(PLACE)
    for at in range(0, len(valid), step - span):  # places within a part must fit PLACE bits
        part = grams[at : at + step]
        key = (part >> PLACE << PLACE) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        least = (key & np.uint64(step - 1)).astype(np.int64)[: len(valid) - at]
        chosen[at + least[valid[at : at + len(least)]]] = True
    place = np.flatnonzero(chosen)
    owner = np.searchsorted(ends, place, "right") - 1
    lo = np.maximum(ends[owner], place - (length - gram))
    hi = np.minimum(ends[owner + 1], place + length)
    raw = data.tobytes()
    around = b"".join([digest(raw[i:j], p - i, j - p) for i, p, j in zip(lo.tolist(), place.tolist(), hi.tolist(), strict=True)])
    return place, grams[place], np.frombuffer(around, np.int64).reshape(-1, 2)


def find_anchors(base: DataFrame, length: int, gram: int) -> DataFrame:
    """g (of the gram), c and d (of the surroundings), row and pos of every anchor of ``base`` (row, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in chunks(batch.column(1), SEGMENT):
                place, g, c = anchors(data, ends, length, gram)
                owner = np.searchsorted(ends, place, "right") - 1
                rows = batch.column(0).slice(first, end - first).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(rows[owner]), pa.array((place - ends[owner]).astype(np.int32))], ["g", "c", "d", "row", "pos"])

    return base.select("row", "text").mapInArrow(find, "g long, c long, d long, row long, pos int")


def common_extension(sums: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray, middle: int, way: int) -> np.ndarray:
    """Length of the common extension from ``middle``, forwards (way 1) or backwards (-1): binary search over prefix hashes, up to limit."""
    low, high = np.zeros(len(x), np.int64), limit.copy()
    while (open_ := low < high).any():
        at = (low + high + 1) >> 1
        same = sums[x, middle + way * at] - sums[x, middle] == sums[y, middle + way * at] - sums[y, middle]
        low = np.where(open_ & same, at, low)
        high = np.where(open_ & ~same, at - 1, high)
    return low


class Suffixes:
    """Rows of bytes around a middle, compared as suffixes from it: forwards, or backwards."""

    def __init__(self, group: np.ndarray, rows: np.ndarray, sums: np.ndarray, reach: np.ndarray, middle: int, way: int):
        self.group, self.rows, self.sums, self.reach, self.middle, self.way = group, rows, sums, reach, middle, way

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return common_extension(self.sums, x, y, np.where(self.group[x] == self.group[y], np.minimum(self.reach[x], self.reach[y]), 0), self.middle, self.way)

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y: by group, then by the first byte that differs, a prefix first."""
        n = self.common(x, y)
        place = self.middle + (n if self.way > 0 else -1 - n)
        ended_x, ended_y = n >= self.reach[x], n >= self.reach[y]
        place = np.clip(place, 0, self.rows.shape[1] - 1)
        smaller = np.where(ended_x | ended_y, ended_x & ~ended_y, self.rows[x, place] < self.rows[y, place])
        return np.where(self.group[x] == self.group[y], smaller, self.group[x] < self.group[y])

    def sort(self) -> np.ndarray:
        """Bottom-up mergesort: in each round every element finds its rank in the run that is merged with its own, all at once."""
        n = len(self.group)
        order, width = np.arange(n), 1
        while width < n:
            index = np.arange(n)
            run = index // width
            start = np.minimum((run ^ 1) * width, n)
            low, high = start.copy(), np.minimum(start + width, n)
            while (open_ := low < high).any():
                at = np.minimum((low + high) >> 1, n - 1)
                mine, other = order[index], order[at]
                # of equal suffixes those of the left run come first
                passes = np.where(run & 1, ~self.before(mine, other), self.before(other, mine))
                low = np.where(open_ & passes, at + 1, low)
                high = np.where(open_ & ~passes, at, high)
            merged = np.empty_like(order)
            merged[(run & ~1) * width + (index - run * width) + (low - start)] = order
            order, width = merged, 2 * width
        return order


def covered(group: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, lowest: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset o, for each row, such that the string from o before its middle is also at that offset of another row of its group; -1 if none.

    ``rows``: bytes around the middle (``left`` and ``right`` of them are the text's). Offsets from ``lowest`` to ``highest`` only.
    """
    n, middle = rows.shape[0], rows.shape[1] - length
    least, most = np.full(n, -1), np.full(n, -1)
    _, group = np.unique(group, return_inverse=True)
    up, _ = powers(rows.shape[1])
    sums = np.zeros((n, rows.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, 500):
            part = BYTE_CODE[rows[at : at + 500]]
            part *= up[: rows.shape[1]]
            np.cumsum(part, axis=1, out=sums[at : at + 500, 1:])
    orders, common = [], []
    for reach, way in ((right, 1), (left, -1)):
        s = Suffixes(group, rows, sums, reach, middle, way)
        order = s.sort()
        orders.append(order)
        common.append(s.common(order[:-1], order[1:]) if n > 1 else np.zeros(0, np.int64))
    for o in range(middle + 1):
        own = np.flatnonzero((left >= o) & (right >= length - o) & (lowest <= o) & (highest >= o))
        if len(own) < 2:
            continue
        classes = np.zeros(n, np.int64)
        for order, same, depth in zip(orders, common, (length - o, o), strict=True):
            part = np.empty(n, np.int64)
            part[order] = np.concatenate([[0], np.cumsum(same < depth)])
            classes = classes * n + part
        by = own[np.argsort(classes[own], kind="stable")]
        equal = np.flatnonzero(classes[by[1:]] == classes[by[:-1]])
        # verified byte by byte: a hash collision would join unequal strings
        real = equal[(rows[by[equal], middle - o : middle - o + length] == rows[by[equal + 1], middle - o : middle - o + length]).all(1) & (group[by[equal]] == group[by[equal + 1]])]
        hit = np.unique(np.concatenate([by[real], by[real + 1]]))
        least[hit] = np.where(least[hit] < 0, o, least[hit])
        most[hit] = o
    return least, most


AROUND = "g long, row long, pos int, alone boolean, l int, r int, bytes binary, lowest int, highest int"
AROUND_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]


def _surroundings(base: DataFrame, kinds: DataFrame, length: int, gram: int) -> DataFrame:
    """g, row, pos, alone and the bytes around one anchor of each kind, with how many of them are left and right of it, and the offsets to look at."""
    listed = kinds.groupBy("row").agg(F.collect_list(F.struct("g", "pos", "alone")).alias("at"))
    joined = base.select("row", "text").join(listed, "row").select("row", "text", "at")
    side = length - gram

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for row, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                for x in at.as_py():
                    a = x["pos"]
                    l, r = min(side, a), min(length, len(raw) - a)
                    for column, value in zip(out, (x["g"], row, a, x["alone"], l, r, raw[a - l : a + r]), strict=True):
                        column.append(value)
                if len(out[0]) > 5_000:
                    yield pack(out)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield pack(out)

    def pack(out: list[list]) -> pa.RecordBatch:
        out = [*out, [0] * len(out[0]), [side] * len(out[0])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, AROUND_TYPES, strict=True)], ["g", "row", "pos", "alone", "l", "r", "bytes", "lowest", "highest"])

    return joined.mapInArrow(cut, AROUND)


def _halved(around: DataFrame, length: int) -> DataFrame:
    """``around`` once for each half of its offsets, grouped (g) by the core that strings at these have in common, with digests (c, d) of all that they hold."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, keys, ranges = [], [], []
            given = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("g", "l", "r", "bytes", "lowest", "highest")), strict=True)
            for i, (g, l, r, raw, low, high) in enumerate(given):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    if max(a, length - r) > min(b, l):
                        continue  # no string of this row is at these offsets
                    begin, end = max(0, l - b), min(len(raw), l + length - a)
                    core = digest(raw[l - a : l + length - b], a, b)
                    keys.append(hashlib.blake2b(core, digest_size=8, key=g.to_bytes(8, "little", signed=True)).digest() + digest(raw[begin:end], l - begin, end - l))
                    take.append(i)
                    ranges.append((a, b))
            number = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 3)
            kept = batch.take(pa.array(take, pa.int64()))
            low, high = (pa.array([x[k] for x in ranges], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(number[:, 0]), *kept.columns[1:7], low, high, pa.array(number[:, 1]), pa.array(number[:, 2])], ["g", "row", "pos", "alone", "l", "r", "bytes", "lowest", "highest", "c", "d"])

    return around.mapInArrow(halve, AROUND + ", c long, d long")


def _matrix(batch: pa.RecordBatch, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    side = length - gram
    left, right = batch.column("l").to_numpy().astype(np.int64), batch.column("r").to_numpy().astype(np.int64)
    rows = np.zeros((batch.num_rows, side + length), np.uint8)
    for i, raw in enumerate(batch.column("bytes")):
        data = np.frombuffer(raw.as_buffer(), np.uint8)
        rows[i, side - left[i] : side - left[i] + len(data)] = data
    return rows, left, right


def _compared(around: DataFrame, length: int, gram: int) -> DataFrame:
    """Covered intervals (row, lo, hi) of anchors that are alone of their kind, by suffix sorts of whole groups."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < BATCH_ROWS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
            g = whole.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield from judge(whole.slice(0, cut))
            held, size = [whole.slice(cut)], whole.num_rows - cut
        if size:
            yield from judge(pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0])

    def judge(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        g = whole.column("g").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        at = 0
        while at < len(bounds) - 1:  # whole groups, a bounded number of rows at once
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BATCH_ROWS, "right")) - 1)
            part = whole.slice(bounds[at], bounds[to] - bounds[at])
            at = to
            rows, left, right = _matrix(part, length, gram)
            least, most = covered(part.column("g").to_numpy(), rows, left, right, length, part.column("lowest").to_numpy(), part.column("highest").to_numpy())
            keep = (least >= 0) & part.column("alone").to_numpy(zero_copy_only=False)
            pos = part.column("pos").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("row").filter(pa.array(keep)), pa.array((pos - most)[keep]), pa.array((pos - least + length)[keep])], ["row", "lo", "hi"])

    parts = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return around.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(settle, "row long, lo long, hi long")


def repeated_bytes(base: DataFrame, *, length: int, gram: int, scratch: Scratch, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Intervals (row, lo, hi) of ``base`` (row, text) that strings of ``length`` bytes which recur cover; hi may pass the end."""
    found = scratch.save(find_anchors(base, length, gram), "anchors")
    differ = (F.min("c") != F.max("c")) | (F.min("d") != F.max("d"))
    shared = scratch.save(found.groupBy("g").agg(F.count("*").alias("n"), differ.alias("differ")).where("n > 1").drop("n"), "shared")
    again = scratch.save(found.join(shared, "g"), "again")
    scratch.drop(found)
    whole = lambda df: df.select("row", (F.col("pos") - (length - gram)).cast("long").alias("lo"), (F.col("pos") + length).cast("long").alias("hi"))
    kinds = scratch.save(again.where("differ").groupBy("g", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first")), "kinds")
    several = scratch.save(kinds.where("n > 1").select("g", "c", "d"), "several")
    out = whole(again.where("not differ")).unionByName(whole(again.where("differ").join(several, ["g", "c", "d"])))
    around = scratch.save(_surroundings(base, kinds.select("g", "first.row", "first.pos", (F.col("n") == 1).alias("alone")), length, gram), "surroundings")
    while True:
        large = scratch.save(around.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > group_rows).select("g"), "large")
        if not large.limit(1).count():
            return out.unionByName(_compared(around, length, gram))
        out = out.unionByName(_compared(around.join(large, "g", "left_anti"), length, gram))
        halves = scratch.save(_halved(around.join(large, "g", "left_semi"), length), "halves")
        # at these offsets equal rows are settled; one of them stays for the others
        own = halves.groupBy("g", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("first"))
        judged = halves.join(scratch.save(own, "equal"), ["g", "c", "d"])
        low, high = F.greatest(F.col("lowest"), length - F.col("r")), F.least(F.col("highest"), F.col("l"))
        settled = judged.where("n > 1 AND alone").select("row", (F.col("pos") - high).cast("long").alias("lo"), (F.col("pos") - low + length).cast("long").alias("hi"))
        out = out.unionByName(settled)
        one = judged.where((F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos")))
        around = scratch.save(one.withColumn("alone", F.col("alone") & (F.col("n") == 1)).select(*around.columns), "surroundings")


def cut_repeats(docs: DataFrame, *, length: int = 400, gram: int = 200, scratch: Scratch | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256, one row per document."""
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    base = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "rows")
    spans = scratch.save(repeated_bytes(base, length=length, gram=gram, scratch=scratch, group_rows=group_rows), "spans")
    listed = spans.groupBy(F.col("row").alias("r")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")).select("r", F.col("spans.lo").alias("los"), F.col("spans.hi").alias("his"))
    joined = base.join(listed, F.col("row") == F.col("r"), "left").select("doc_id", "text", "los", "his")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in chunks(batch.column(1), 4 << 20):
                part = batch.slice(first, end - first)
                out: list[list] = [[] for _ in range(5)]
                for i in range(end - first):
                    raw, n = data[ends[i] : ends[i + 1]].tobytes(), int(ends[i + 1] - ends[i])
                    kept, last, count = [], 0, 0
                    if part.column(2)[i].is_valid:
                        lo, hi = part.column(2)[i].values.to_numpy(), part.column(3)[i].values.to_numpy()
                        lo, hi = np.maximum(lo, 0), np.maximum.accumulate(np.minimum(hi, n))
                        fresh = np.concatenate([[True], lo[1:] > hi[:-1]])
                        for a, b in zip(lo[fresh], np.concatenate([hi[:-1][fresh[1:]], hi[-1:]]), strict=True):
                            kept.append(raw[last:a])
                            last, count = int(b), count + 1
                    kept = b"".join([*kept, raw[last:]])
                    for column, value in zip(out, (n, n - len(kept), count, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
