"""Analysis of report rows: filters, counts, distributions, top examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.scoring import assessment

TRAINING = ("training_file", "training_line")


def suite() -> Column:
    return F.coalesce("eval_key", "eval_dataset")


def filter_reports(reports: DataFrame, *, eval_key: str | None = None, min_score: float | None = None, min_ngrams: int | None = None) -> DataFrame:
    """Rows of a suite, from a score, from a number of n-grams; a null fails a filter that is set."""
    if eval_key is not None:
        reports = reports.where(suite() == eval_key)
    if min_score is not None:
        reports = reports.where(F.col("contamination_score") >= min_score)
    return reports.where(F.col("ngram_match_cnt") >= min_ngrams) if min_ngrams is not None else reports


def suite_documents(reports: DataFrame) -> DataFrame:
    """Distinct training documents by suite, most first."""
    return reports.groupBy(suite().alias("eval_key")).agg(F.count_distinct(*TRAINING).alias("n_documents")).orderBy(F.desc("n_documents"), "eval_key")


def suite_instances(reports: DataFrame) -> DataFrame:
    """Distinct eval instances (or lines) by suite, most first."""
    return reports.groupBy(suite().alias("eval_key")).agg(F.count_distinct(F.coalesce("eval_instance_index", "eval_line")).alias("n_instances")).orderBy(F.desc("n_instances"), "eval_key")


def summary(reports: DataFrame) -> DataFrame:
    instance = F.struct("eval_dataset", F.coalesce("eval_instance_index", "eval_line"))
    return reports.agg(F.count_distinct(*TRAINING).alias("n_documents"), F.count("*").alias("n_matches"), F.count_distinct(instance).alias("n_instances"))


def compare_summary(reports: DataFrame) -> DataFrame:
    """As summary, an instance being a suite, a split ('unknown' if null) and an index."""
    instance = F.struct(suite(), F.coalesce("split", F.lit("unknown")), "eval_instance_index")
    return reports.agg(F.count_distinct(*TRAINING).alias("n_documents"), F.count("*").alias("n_matches"), F.count_distinct(instance).alias("n_instances"))


def ngram_stats(reports: DataFrame) -> DataFrame:
    """Least, greatest, (upper) median and mean n-gram count."""
    c = F.col("ngram_match_cnt")
    return reports.agg(F.min(c).alias("min_ngrams"), F.max(c).alias("max_ngrams"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ngram_match_cnt DESC)").cast("long").alias("median_ngrams"), F.avg(c).alias("avg_ngrams"))


def ngram_histogram(reports: DataFrame) -> DataFrame:
    """Rows by class of n-gram count; empty classes are left out."""
    c, bounds = F.col("ngram_match_cnt"), (10, 20, 30, 50, 100, 200, 500)
    bucket = F.lit(f">{bounds[-1]}")
    for low, high in reversed(list(zip((0, *bounds), bounds, strict=False))):
        bucket = F.when(c <= high, f"{low + 1}-{high}").otherwise(bucket)
    return reports.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_rows"))


def removals(reports: DataFrame) -> DataFrame:
    """Distinct training documents by the first part of the training path."""
    first = F.element_at(F.split("training_file", "/"), 1)
    return reports.groupBy(first.alias("training_dataset")).agg(F.count_distinct(*TRAINING).alias("n_removed")).orderBy(F.desc("n_removed"), "training_dataset")


def top_examples(reports: DataFrame, limit: int = 10) -> DataFrame:
    """Most matched eval lines with their rank, a sample of the eval text and the first three training files by name."""
    key = ["eval_dataset", "eval_line"]
    top = reports.groupBy(*key).agg(F.count("*").alias("n_matches")).orderBy(F.desc("n_matches"), *key).limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_matches"), *key)))  # limit rows
    text = F.col("eval_question_text") if "eval_question_text" in reports.columns else F.lit(None).cast("string")
    rows = reports.select(*key, "training_file", text.alias("eval_text")).join(F.broadcast(top.select(*key)), key)
    # of many files of one line only three are kept on the way
    place = Window.partitionBy(*key).orderBy("training_file")
    files = rows.select(*key, "training_file").distinct().withColumn("place", F.row_number().over(place)).where("place <= 3").groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("training_file")), ",").alias("files"))
    sample = rows.groupBy(*key).agg(F.min("eval_text").alias("eval_text"))
    return top.join(files, key).join(sample, key).select("rank", *key, "n_matches", "files", "eval_text").orderBy("rank")


def review_order(reports: DataFrame, by: str = "score") -> DataFrame:
    """Rows by score (the lowest first), or by n-gram count ('ngrams', 'ngrams_asc')."""
    key = {"score": F.coalesce("contamination_score", F.lit(0.0)).asc(), "ngrams": F.desc("ngram_match_cnt"), "ngrams_asc": F.asc("ngram_match_cnt")}[by]
    return reports.orderBy(key, *TRAINING, "eval_dataset", "eval_line")


def assessments(reports: DataFrame) -> DataFrame:
    return reports.groupBy(assessment(F.col("contamination_score")).alias("assessment")).agg(F.count("*").alias("n_rows"))
