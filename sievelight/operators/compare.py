"""Differences of two runs' reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["training_file", "training_line", "eval_dataset", "eval_line"]


def keyed(reports: DataFrame) -> DataFrame:
    """One row for each key: that with the highest score."""
    order = Window.partitionBy(*KEY).orderBy(F.col("contamination_score").desc_nulls_last(), F.col("eval_instance_index").asc_nulls_first())
    return reports.withColumn("copy", F.row_number().over(order)).where("copy = 1").drop("copy")


def only_in(first: DataFrame, second: DataFrame) -> DataFrame:
    return keyed(first).join(second.select(*KEY).distinct(), KEY, "left_anti")


def in_both(first: DataFrame, second: DataFrame) -> DataFrame:
    """Common keys, both scores and their difference, greatest change first."""
    other = keyed(second).select(*KEY, F.col("contamination_score").alias("second_score"))
    both = keyed(first).select(*KEY, F.col("contamination_score").alias("first_score")).join(other, KEY)
    return both.withColumn("delta", F.col("second_score") - F.col("first_score")).orderBy(F.desc(F.abs("delta")), *KEY)


def suite_deltas(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows by suite in both runs, 0 where a run has none."""
    count = lambda df, name: df.groupBy("eval_dataset").agg(F.count("*").alias(name))
    both = count(first, "n_first").join(count(second, "n_second"), "eval_dataset", "full_outer").fillna(0, ["n_first", "n_second"])
    return both.withColumn("delta", F.col("n_second") - F.col("n_first")).orderBy(F.desc("delta"), "eval_dataset")


def score_changes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Common rows that improved (a lower score), worsened or stayed, and mean changes."""
    d = F.col("delta")
    same, better, worse = F.abs(d) < 0.001, d <= -0.001, d >= 0.001
    return in_both(first, second).agg(F.count_if(better).alias("improved"), F.count_if(worse).alias("worsened"), F.count_if(same).alias("unchanged"), F.avg(F.when(better, -d)).alias("mean_improvement"), F.avg(F.when(worse, d)).alias("mean_worsening"))


def average_score(reports: DataFrame) -> DataFrame:
    """Sum of scores by the number of rows, those without a score included."""
    return reports.agg((F.coalesce(F.sum("contamination_score"), F.lit(0.0)) / F.count("*")).alias("avg_score"))


def fingerprints_only_in(first: DataFrame, second: DataFrame) -> DataFrame:
    """Fingerprints that only the first run has, by number of rows."""
    own = first.where("fingerprint IS NOT NULL").join(second.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return own.groupBy("fingerprint").agg(F.count("*").alias("n_rows"), F.max("contamination_score").alias("best_score")).orderBy(F.desc("n_rows"), "fingerprint")


def fingerprint_groups(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows whose fingerprint only the first run has, one per key: rows by score within groups, groups by size; group and item count from 1."""
    rows = keyed(first).where("fingerprint IS NOT NULL").join(second.select("fingerprint").distinct(), "fingerprint", "left_anti")
    item = Window.partitionBy("fingerprint").orderBy(F.coalesce("contamination_score", F.lit(0.0)), *KEY)
    sizes = rows.groupBy("fingerprint").agg(F.count("*").alias("group_size"))
    # one row per fingerprint
    groups = sizes.withColumn("group", F.row_number().over(Window.orderBy(F.desc("group_size"), "fingerprint")))
    return rows.withColumn("item", F.row_number().over(item)).join(groups, "fingerprint").orderBy("group", "item")


def all_suites(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("eval_dataset").union(second.select("eval_dataset")).distinct()
