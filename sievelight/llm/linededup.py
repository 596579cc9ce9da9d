"""Line dedup: runs of lines that occur earlier in the corpus are deleted, by DataFrame operations only.

The corpus is a sequence of line ids. Its suffix array is built by distributed prefix doubling:
ranks of suffixes by their first k lines, paired with the ranks k lines further on, are ranked
again by their first 2k lines, until ``min_lines`` lines are compared. A suffix whose rank is
alone is finished and leaves. Equal ranks at that depth are the intervals of the suffix array
whose longest common prefix is at least ``min_lines``; in each, the first suffix in corpus order
(doc_id, then row, then line) stays, and the windows of the others, joined where they touch, are
the maximal repeated runs, which are deleted. With ``min_words``, a shorter run of equal lines that
holds so many words is deleted too; then every depth below ``min_lines`` is ranked.

Cases: a null text has no lines and stays null; an empty text is one empty line; a document of
fewer than ``min_lines`` lines loses nothing; repeated rows are documents of their own, of which
the later one loses its lines; a null doc_id comes last; an empty table gives no rows; columns
other than text are kept as they are, but ``dedup_lines`` leaves out those named as its counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.scratch import Scratch


def ranks(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct rows with a number ``next`` in their order: by range partition, then by place in it."""
    own = keys.columns
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(parts, *own).withColumn("part", F.spark_partition_id())
    placed = F.row_number().over(Window.partitionBy("part").orderBy(*own))
    return scratch.save(dealt.select(*own, (F.col("part").cast("long") * (1 << 40) + placed).alias("next")), "ranks")


def repeated_windows(lines: DataFrame, min_lines: int, min_words: int | None, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """(depth, suffixes): row, doc_id, pos of suffixes that share their first ``min_lines`` lines with another, with their rank at that depth.

    With ``min_words`` also, of each lower depth, those whose lines hold so many words.
    ``lines``: row, doc_id, pos, rank (a line id), words.
    """
    repeated = scratch.save(lines.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"), "repeated")
    active = scratch.save(lines.join(repeated, "rank"), "depth1")
    depth, out = 1, []
    while depth < min_lines:
        if min_words is not None:
            out.append((depth, active.where(F.col("words") >= min_words)))
        step = min(depth, min_lines - depth) if min_words is None else 1
        # of the lines further on, a depth of ``step`` is needed only: with min_words, the lines themselves
        source = active if min_words is None else lines
        further = source.select("row", (F.col("pos") - (step if min_words is None else depth)).alias("pos"), F.col("rank").alias("rank2"), F.col("words").alias("words2"))
        paired = scratch.save(active.join(further, ["row", "pos"]).select("row", "doc_id", "pos", "rank", "rank2", (F.col("words") + F.col("words2")).alias("words")), "paired")
        groups = paired.groupBy("rank", "rank2").agg(F.count("*").alias("n")).where("n > 1").select("rank", "rank2")
        named = ranks(groups, scratch)
        active = scratch.save(paired.join(named, ["rank", "rank2"]).select("row", "doc_id", "pos", F.col("next").alias("rank"), "words"), "deeper")
        depth += step
    return [*out, (depth, active)]


def later_runs(lines: DataFrame, min_lines: int, min_words: int | None, scratch: Scratch) -> DataFrame:
    """Maximal runs to delete, per row: arrays of first lines and of ends, in order."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row"), F.col("pos"))
    later = None
    for depth, windows in repeated_windows(lines, min_lines, min_words, scratch):
        firsts = scratch.save(windows.groupBy("rank").agg(F.min(place).alias("first")), "firsts")
        own = windows.join(firsts, "rank").where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos"))).select("row", "pos", (F.col("pos") + depth).alias("end"))
        later = own if later is None else later.unionByName(own)
    order = Window.partitionBy("row").orderBy("pos", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("pos") <= reached, 0).otherwise(1)
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "run").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs")).select("row", F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends"))


COUNTS = ["n_lines", "n_removed", "n_runs"]


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, ...) with text without its repeated runs, and n_lines, n_removed, n_runs."""
    return _deduped(docs, **options).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in COUNTS], *COUNTS)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with text without its repeated runs; those that consist of such runs only go."""
    left = _deduped(docs, **options).where("n_removed = 0 OR n_removed < n_lines")
    return left.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def _deduped(docs: DataFrame, *, min_lines: int = 3, min_words: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc (a struct of the columns, text without its repeated runs) and the counts."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    own = [f"`{c}`" for c in docs.columns]
    base = scratch.save(docs.select(F.struct(*own).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "rows")
    words = lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).cast("long") if min_words is not None else F.lit(0).cast("long")
    ids = F.transform(F.split("doc.text", "\n", -1), lambda x: F.struct(F.unhex(F.md5(x)).alias("rank"), words(x).alias("words")))
    lines = base.where("doc.text IS NOT NULL").select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.posexplode(ids).alias("pos", "line")).select("row", "doc_id", "pos", "line.rank", "line.words")
    runs = later_runs(scratch.save(lines, "lines"), min_lines, min_words, scratch)
    joined = base.join(runs.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    joined = joined.withColumn("parts", F.split("doc.text", "\n", -1))
    n = F.coalesce(F.size("parts"), F.lit(0))
    kept = F.flatten(F.zip_with(F.concat(F.array(F.lit(0)), "ends"), F.concat("starts", F.array(F.size("parts"))), lambda a, b: F.slice(F.col("parts"), a + 1, b - a)))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda x, y: x + y)
    text = F.when(F.col("starts").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return joined.select(F.struct(*columns).alias("doc"), F.when(F.col("doc.text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_runs"))
