"""Sinks: reports and cleaned corpora in a tree like the input's, chunked eval sets.

Spark writes parts; the driver then gives them their names. It handles lists of files only, never
their rows.
"""

from __future__ import annotations

import gzip
import posixpath
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.text import fingerprint

COMPRESSED = (".gz", ".zst", ".zstd", ".bz2", ".xz")
#: Lines of an input file that one task writes.
PART_LINES = 1_000_000


def relative_name(file: str, base: str | None) -> str:
    """A file's path below the base folder; its name alone if it is not below it."""
    plain = lambda p: re.sub(r"^[a-z0-9]+:/*(?=/)", "", p)
    file, base = plain(file), plain(base or "").rstrip("/") + "/"
    return file[len(base) :] if len(base) > 1 and file.startswith(base) else posixpath.basename(file)


def report_name(file: str, base: str | None, threshold: float, mode: str = "simple") -> str:
    """Of a report: the input's folder, its name without the last extension, mode and threshold."""
    folder, name = posixpath.split(relative_name(file, base))
    return posixpath.join(folder, f"{name.rpartition('.')[0] or name}-{mode}-{threshold:.2f}.jsonl")


def purified_name(file: str, base: str | None) -> str:
    """Of a cleaned file: the input's folder and its name up to .jsonl, gzipped."""
    folder, name = posixpath.split(relative_name(file, base))
    stem = name[: name.index(".jsonl")] if ".jsonl" in name else name.rpartition(".")[0] or name
    return posixpath.join(folder, f"{stem}.jsonl.gz")


class _Folder:
    """A folder of any file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.files = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def parts(self, name: str) -> list[str]:
        """Names of the data files in a folder below."""
        if not self.files.exists(self.at(name)):
            return []
        found = [status.getPath().getName() for status in self.files.listStatus(self.at(name))]
        return sorted(f"{name}/{x}" for x in found if x.startswith("part-"))

    def move(self, source: str, target: str) -> None:
        self.files.mkdirs(self.at(target).getParent())
        self.files.delete(self.at(target), False)
        self.files.rename(self.at(source), self.at(target))

    def write(self, name: str, data: bytes) -> None:
        self.files.mkdirs(self.at(name).getParent())
        out = self.files.create(self.at(name), True)
        out.write(bytearray(data))
        out.close()

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)


def _numbered(df: DataFrame, files: list[str]) -> DataFrame:
    """``df`` with file_no, the place of training_file in a list of files."""
    table = df.sparkSession.createDataFrame(list(enumerate(files)), "file_no int, name string")
    return df.join(F.broadcast(table), F.col("training_file") == F.col("name")).drop("name")


def _placed(folder: _Folder, staged: str, files: list[str], names: list[str], rest: bytes | None) -> None:
    """Give each file's parts its name; more than one part get numbers; none is written as ``rest``, if that is given."""
    for number, name in enumerate(names):
        parts = [x for p in _subfolders(folder, f"{staged}/file_no={number}") for x in folder.parts(p)]
        if len(parts) == 1:
            folder.move(parts[0], name)
        elif not parts and rest is not None:
            folder.write(name, rest)
        else:
            stem, dot, extension = name.partition(".jsonl")
            for i, part in enumerate(parts):
                folder.move(part, f"{stem}-{i + 1:05d}{dot}{extension}")
    folder.delete(staged)


def _subfolders(folder: _Folder, name: str) -> list[str]:
    if not folder.files.exists(folder.at(name)):
        return []
    found = [s.getPath().getName() for s in folder.files.listStatus(folder.at(name)) if s.isDirectory()]
    return [f"{name}/{x}" for x in sorted(found, key=lambda x: int(x.rpartition("=")[2]))]


def write_reports(report: DataFrame, path: str, *, base: str | None = None, threshold: float = 0.8, mode: str = "simple") -> list[str]:
    """JSON rows without null fields, a file for each training file that has any; their names."""
    files = sorted(r[0] for r in report.select("training_file").distinct().collect())
    staged = f"_staged-{uuid.uuid4().hex}"
    part = F.expr(f"training_line div {PART_LINES}")
    rows = _numbered(report, files).withColumn("lines", part)
    rows.repartition("file_no", "lines").sortWithinPartitions("file_no", "lines", "training_line").write.partitionBy("file_no", "lines").option("ignoreNullFields", True).json(f"{path.rstrip('/')}/{staged}")
    names = [report_name(f, base, threshold, mode) for f in files]
    _placed(_Folder(report.sparkSession, path), staged, files, names, None)
    return names


def write_purified(lines: DataFrame, matches: DataFrame, path: str, *, base: str | None = None) -> list[str]:
    """Lines (training_file, training_line, raw) without the matched ones, gzipped, a file for each input file, also where no line is left; their names."""
    files = sorted(r[0] for r in lines.select("training_file").distinct().collect())
    staged = f"_staged-{uuid.uuid4().hex}"
    kept = lines.join(matches.select("training_file", "training_line").distinct(), ["training_file", "training_line"], "left_anti")
    rows = _numbered(kept, files).withColumn("lines", F.expr(f"training_line div {PART_LINES}"))
    dealt = rows.repartition("file_no", "lines").sortWithinPartitions("file_no", "lines", "training_line")
    dealt.select("file_no", "lines", F.col("raw").alias("value")).write.partitionBy("file_no", "lines").option("compression", "gzip").text(f"{path.rstrip('/')}/{staged}")
    names = [purified_name(f, base) for f in files]
    _placed(_Folder(lines.sparkSession, path), staged, files, names, gzip.compress(b""))
    return names


def row_bytes(columns: list[Column]) -> Column:
    """Size of a row as JSON, with its line end."""
    return F.octet_length(F.to_json(F.struct(*columns))) + 1


def write_evals(rows: DataFrame, path: str, *, chunk_bytes: int = 100_000_000) -> None:
    """Eval rows with their fingerprints, by suite and split, gzipped, in chunks of about ``chunk_bytes`` of JSON."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    if "fingerprint" not in rows.columns:
        rows = rows.withColumn("fingerprint", fingerprint(have("passage"), have("question"), have("answer")))
    mean = rows.agg(F.avg(row_bytes([F.col(f"`{c}`") for c in rows.columns]))).first()[0] or 1.0
    by = [c for c in ("eval_key", "split") if c in rows.columns]
    rows.write.mode("overwrite").partitionBy(*by).option("maxRecordsPerFile", max(1, int(chunk_bytes / mean))).option("ignoreNullFields", True).option("compression", "gzip").json(path)
