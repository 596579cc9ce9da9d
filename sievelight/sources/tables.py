"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table in few files from which, and up to which, its rows are dealt to all cores: a single row group is one task.
SPREAD_FROM, SPREAD_TO = 1 << 20, 1 << 30


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table, its rows dealt to all cores if it is small and has fewer files than these; a large one is left as it lies."""
    df = spark.read.parquet(path)
    files, cores = df.inputFiles(), spark.sparkContext.defaultParallelism
    if not 0 < len(files) < cores:
        return df
    conf, paths = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    size = sum(paths(f).getFileSystem(conf).getFileStatus(paths(f)).getLen() for f in files)
    return df.repartition(cores) if SPREAD_FROM <= size <= SPREAD_TO else df
