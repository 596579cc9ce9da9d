"""WARC archives: revisit resolution and deduplicated output.

An archive is a real WARC/1.0 file, written by Spark's text writer (every record ends with two
line ends, which serve as the line separator) into any file system, and read again as whole
files, record by record after Content-Length. Headers are shuffled by payload digest; digests that
repeat are then broadcast to the records, or, beyond ``BROADCAST_ROWS`` of them, shuffled with these.

Cases: a null payload is empty; equal payloads of fewer than ``least`` bytes are all responses;
of equal payloads the smallest page_id (nulls last) is the response, and repeated rows with that
page_id are responses too, as they name one record; an empty table writes no record; a revisit
whose original is missing resolves to null bytes and keeps its digest; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.scratch import Scratch

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SCHEMA = "record_id string, page_id long, record_type string, target_uri string, refers_to_id string, payload_digest string, payload binary"
#: Payload bytes that a reader hands on at once.
BATCH_BYTES = 4 << 20
#: Repeated digests (of about 60 bytes) up to which they are broadcast.
BROADCAST_ROWS = 200_000


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: each 40 bits are eight digits."""
    parts = [F.lpad(F.conv(F.substr(sha1, F.lit(10 * i + 1), F.lit(10)), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve_revisits(headers: DataFrame, records: DataFrame, *, least: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """``records`` with record_type and refers_to, from ``headers`` of the same rows without payloads (page_id, payload_bytes, payload_digest)."""
    scratch = scratch or Scratch(headers.sparkSession, "warc")
    groups = headers.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    repeated = scratch.save(groups.where("n > 1").drop("n"), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)  # else both sides are shuffled by digest, and AQE splits a hot one
    joined = records.join(repeated, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= least), "left").drop("d")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("original"))).drop("original")


def record_text(payload: Column) -> Column:
    """One record without its end; ``payload`` is null for a revisit."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.coalesce(payload, F.lit("")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    return F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit("2024-01-01T00:00:00Z")), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


def write_archives(records: DataFrame, path: str, text_col: str = "html") -> None:
    """Gzipped WARC files of ``records`` (page_id, url, text, record_type, refers_to, payload_digest)."""
    records.select(record_text(F.col(text_col)).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    spark = records.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt.gz"):
            files.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt.gz") + ".warc.gz"))


def parse_records(archive: BinaryIO) -> Iterator[tuple]:
    """The records of one archive, one at a time."""
    while archive.readline():  # the version
        fields = {}
        while (line := archive.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        payload = archive.read(int(fields["content-length"]))
        archive.read(len(END))
        ident = fields["warc-record-id"].strip("<>").rpartition(":")[2]
        yield (
            fields["warc-record-id"], None if ident == "none" else int(ident), fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            fields.get("warc-payload-digest", "").removeprefix("sha1:"), None if fields["warc-type"] == "revisit" else payload,
        )


def read_archives(spark, path: str) -> DataFrame:
    """Records of the archives under a path; the payload of a revisit is null."""
    names = ["record_id", "page_id", "record_type", "target_uri", "refers_to_id", "payload_digest", "payload"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    rows.append(row)
                    size += len(row[6] or b"") + 200
                    if size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content").mapInArrow(parse, SCHEMA)


def payload_digests(records: DataFrame) -> DataFrame:
    """Size and digest of each response's payload as read, in place of the payload."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("payload")).to_pylist()
            size = pa.array([None if x is None else len(x) for x in raw], pa.int64())
            sha = pa.array([None if x is None else base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size, sha], [*batch.schema.names[:-1], "payload_bytes", "read_digest"])

    return records.mapInArrow(digest, SCHEMA.removesuffix(", payload binary") + ", payload_bytes long, read_digest string")


def dedup_archives(pages: DataFrame, *, least: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as deduplicated archives, read them back and resolve every revisit.

    One row per page: page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    given = pages.select("page_id", "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    records = given.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("sha1", F.sha1(payload)).withColumn("payload_digest", base32(F.col("sha1"))).drop("sha1")
    headers = scratch.save(records.select("page_id", "payload_bytes", "payload_digest"), "headers")
    path = scratch.path("archives")
    write_archives(resolve_revisits(headers, records, least=least, scratch=scratch), path)
    back = scratch.save(payload_digests(read_archives(spark, path)), "read")
    originals = back.where("record_type = 'response'").groupBy(F.col("record_id").alias("original")).agg(F.min("payload_bytes").alias("original_bytes"), F.min("page_id").alias("original_page"))
    revisits = back.where("record_type = 'revisit'").join(originals, F.col("refers_to_id") == F.col("original"), "left")
    revisits = revisits.select("page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("original_page").alias("refers_to"))
    responses = back.where("record_type = 'response'")
    return responses.select("page_id", "payload_bytes", F.col("read_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
