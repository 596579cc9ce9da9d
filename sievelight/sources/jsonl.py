"""JSON-lines sources: training text, eval rows and report rows, plain or compressed (gz, bz2, zst, xz)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.functions.text import nested_text
from sievelight.operators.normalize import eval_length_stats

FILES = "*.{json,jsonl,json.gz,jsonl.gz,json.zst,jsonl.zst,json.zstd,jsonl.zstd,json.bz2,jsonl.bz2,json.xz,jsonl.xz}"


def text_lines(spark: SparkSession, path: str | list[str], pattern: str = FILES) -> DataFrame:
    """training_file, training_line (from 0) and raw of every line below a path.

    Plain files are read in splits, gz and bz2 as Spark reads them; lines are numbered by their place
    in a split and by the lines of the splits before. xz and zst, which Spark's text reader does not
    unpack here, are unpacked in Python, line by line.
    """
    plain = ",".join(p for p in pattern.removeprefix("*.{").removesuffix("}").split(",") if not p.endswith(("xz", "zst", "zstd")))
    read = spark.read.text(path, pathGlobFilter="*.{" + plain + "}", recursiveFileLookup=True, lineSep="\n")
    lines = read.select(F.col("_metadata.file_path").alias("training_file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("raw"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("training_file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("training_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    numbered = lines.join(blocks, ["training_file", "block"]).select("training_file", (F.col("before") + F.col("id") - F.col("first")).alias("training_line"), "raw")
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xz,zst,zstd}").option("recursiveFileLookup", True).load(path).select("path", "content")
    return numbered.unionByName(packed.mapInArrow(_unpacked, "training_file string, training_line long, raw string"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io
    import lzma

    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            file = io.BytesIO(content.as_py())
            if name.endswith("xz"):
                lines = io.BufferedReader(lzma.open(file))
            else:
                import zstandard

                lines = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True))
            number = 0
            while held := lines.readlines(1 << 20):
                raw = [x.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace") for x in held]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(raw)), pa.array(range(number, number + len(raw)), pa.int64()), pa.array(raw, pa.string())], ["training_file", "training_line", "raw"])
                number += len(raw)


def with_file_ids(lines: DataFrame) -> DataFrame:
    """``lines`` with doc_id, one for each file and line: the file's place in the order of names, and the line, which has 40 bits."""
    # one row per file: a list of names, not data
    files = lines.select("training_file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("training_file")).cast("long"))
    return lines.join(F.broadcast(files), "training_file").withColumn("doc_id", F.shiftleft("file_no", 40) + F.col("training_line")).drop("file_no")


def training_documents(spark: SparkSession, path: str, content_key: str = "text") -> DataFrame:
    """doc_id (of file and line), training_file, training_line, raw and text; lines without a string at the key go."""
    return with_file_ids(text_lines(spark, path)).withColumn("text", nested_text(F.col("raw"), content_key)).where("text IS NOT NULL")


def eval_documents(spark: SparkSession, path: str) -> DataFrame:
    """Eval rows below a path: comment lines and rows without a doc_id are left out, missing keys take the file's name and line."""
    lines = text_lines(spark, path).where(~F.col("raw").startswith("#"))
    schema = "doc_id long, eval_key string, eval_name string, eval_instance_index long, split string, fingerprint string, is_correct boolean, question string, answer string, passage string, config string, sub_index long"
    rows = lines.withColumn("j", F.from_json("raw", schema)).where("j.doc_id IS NOT NULL")
    stem = F.regexp_replace(F.element_at(F.split("training_file", "/"), -1), r"\.jsonl?(\.[a-z0-9]+)?$", "")
    return with_file_ids(rows).select(
        F.col("doc_id").alias("eval_id"), F.coalesce("j.eval_key", "j.eval_name", stem).alias("eval_key"), F.col("training_line").alias("eval_line"),
        F.coalesce("j.eval_instance_index", "training_line").alias("eval_instance_index"), "j.split", "j.fingerprint", "j.is_correct", F.col("training_file").alias("reference_file"), "j.question", "j.answer", "j.passage", F.col("j.doc_id").alias("doc_id"),
    )


def eval_files_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Lengths by suite of the eval rows below a path, with the number of rows that were left out for want of an eval_key.

    Lines that are blank or no JSON are neither.
    """
    texts = "eval_key string, question string, answer string, passage string"
    lines = text_lines(spark, path).where(F.trim("raw") != "").withColumn("j", F.try_parse_json("raw")).where("j IS NOT NULL")
    rows = lines.select(F.from_json("raw", texts).alias("r")).select("r.*")
    skipped = rows.agg(F.count_if(F.trim(F.coalesce("eval_key", F.lit(""))) == "").alias("skipped_rows"))
    return eval_length_stats(rows).crossJoin(F.broadcast(skipped))  # one row


def report_schema() -> str:
    texts = ["training_overlap_text", "eval_question_text", "eval_answer_text", "eval_passage_text", "fingerprint", "split", "reference_file", "method"]
    longs = ["ngram_match_cnt", "eval_unique_ngrams", "question_start_idx", "question_end_idx", "cluster_token_length", "eval_token_length", "answer_start_idx", "answer_end_idx", "passage_start_idx", "passage_end_idx", "contamination_start_idx", "contamination_end_idx"]
    doubles = ["contamination_score", "length_adjusted_question_threshold", "idf_overlap", "answer_overlap_ratio", "answer_idf_overlap", "passage_overlap_ratio", "passage_idf_overlap", "length_penalty", "ngram_jaccard"]
    key = "training_file string, training_line long, eval_dataset string, eval_key string, eval_line long, eval_instance_index long, token_length_delta int, is_correct boolean, answer_boundaries array<array<long>>"
    return ", ".join([key, *[f"{c} string" for c in texts], *[f"{c} long" for c in longs], *[f"{c} double" for c in doubles]])


def read_reports(spark: SparkSession, path: str, with_source: bool = False) -> DataFrame:
    """Report rows below a path; a row that does not parse is left out, not its file."""
    rows = spark.read.schema(report_schema()).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,jsonl,json.gz,jsonl.gz}").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("report_file")) if with_source else rows
