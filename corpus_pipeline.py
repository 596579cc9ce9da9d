"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mix.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.decontaminate import decontaminate
from sievelight.llm.linededup import without_repeats
from sievelight.llm.mixing import mix_counts
from sievelight.llm.quality import keep_good
from sievelight.llm.scratch import Scratch
from sievelight.llm.setsketch import keep_one


def _resized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of documents whose text may have changed: n_chars follows the text."""
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in columns else None
    return docs.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on rated ones of this input, does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of three lines, or of 50 words in fewer, that occur earlier; one that consists of such runs only goes."""
    return _resized(without_repeats(docs, min_lines=3, min_words=50, scratch=Scratch(spark, "lines")), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the least doc_id."""
    return keep_one(docs, scratch=Scratch(spark, "near"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows do not cover to 5 %; shorter hits are cut out of the others."""
    return _resized(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mix_counts(docs, scratch=Scratch(spark, "mix"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: The classifier, the sketches' confirmed links and the permuted blocks are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
