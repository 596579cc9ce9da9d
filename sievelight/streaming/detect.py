"""Detection over a growing folder: every micro-batch is matched against a static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from sievelight.functions.text import nested_text
from sievelight.operators.index import Index
from sievelight.plans.detect import detect, purify, report, search
from sievelight.sources.jsonl import text_lines, with_file_ids
from sievelight.sources.sinks import write_purified, write_reports


def read_folder(spark: SparkSession, path: str, schema: StructType | str = "doc_id long, text string", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def detect_stream(docs: DataFrame, index: Index, reports: str, checkpoint: str, cleaned: str | None = None) -> StreamingQuery:
    """Write each batch's matches, and its documents without matches, under folders by batch; a batch that runs again overwrites its own. No state is kept between batches."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        held = search(df, index)
        found = detect(df, index, found=held).select("doc_id", "eval_id", "start", "end", "idf_overlap", "answer_idf_overlap", "passage_idf_overlap", "contamination_score").persist()
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{reports}/batch={number}")
        if cleaned:
            purify(df, found).write.mode("overwrite").parquet(f"{cleaned}/batch={number}")
        for kept in (found, held, df):
            if kept is not None:
                kept.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_folder(spark: SparkSession, source: str, index: Index, reports: str, checkpoint: str, *, cleaned: str | None = None, upload: Callable[[list[str]], None] | None = None, files: int = 16) -> StreamingQuery:
    """Score the JSONL files of a folder as they come, ``files`` at once: a report and, if asked for, a cleaned file for each.

    The checkpoint knows which files are done, so a run that is started again goes on where it
    stopped; files that were under way are written again under the same names. ``upload`` gets
    the names of what a batch wrote.
    """
    options = index.options

    def batch(df: DataFrame, number: int) -> None:
        paths = [r[0] for r in df.select("path").distinct().collect()]
        if not paths:
            return
        lines = with_file_ids(text_lines(spark, paths)).persist()
        docs = lines.withColumn("text", nested_text(F.col("raw"), options.content_key)).where("text IS NOT NULL")
        held = search(docs, index)
        found = report(detect(docs, index, found=held), docs, index).persist()
        names = write_reports(found, reports, base=source, threshold=options.contamination_score_threshold)
        if cleaned:
            names += write_purified(lines, found, cleaned, base=source)
        if upload:
            upload(names)
        for kept in (found, held, lines):
            if kept is not None:
                kept.unpersist()

    names = spark.readStream.format("text").option("pathGlobFilter", "*.jsonl*").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(source).select(F.col("_metadata.file_path").alias("path"))
    return names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
