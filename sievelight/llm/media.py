"""Media columns: payloads stored as lossless WebP images, and features of their pixel arrays.

A payload is stored as one image, or, if it is longer than a tile, as one after another; their
sizes part them again. How an image is coded, its content decides (see ``webpbatch``).

Cases: a null text is empty; an empty text is 64 zero bytes; equal texts give equal values;
repeated rows are stored row by row; an empty table stores nothing; extra columns are ignored;
a text of any size is stored whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm import webp, webpbatch
from sievelight.llm.bytewords import chunks
from sievelight.llm.scratch import Scratch

UNIT = 64
#: Bytes of payload in one image, and of the texts that are coded at once.
TILE = 8 << 10
BATCH_BYTES = 8 << 20


def padded_size(n: int) -> int:
    return max(UNIT, -(-n // UNIT) * UNIT)


def to_image(payload: np.ndarray) -> np.ndarray:
    """Bytes, a multiple of 64, as rows of pixels; a payload too high for one image is made wider, with zeros at the end."""
    rows = len(payload) // UNIT
    wide = -(-rows // webp.MAX_SIDE)
    high = -(-rows // wide)
    if high * wide > rows:
        payload = np.concatenate([payload, np.zeros((high * wide - rows) * UNIT, np.uint8)])
    return payload.reshape(high, 16 * wide, 4)


def tiles_of(media: bytes) -> list[bytes]:
    """The files that lie one after another."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at:end])
        at = end
    return out


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the image (media) of every text."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in chunks(batch.column(1), BATCH_BYTES):
                tiles, count = [], []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    payload = np.zeros(padded_size(int(b - a)), np.uint8)
                    payload[: b - a] = data[a:b]
                    tiles += [to_image(payload[at : at + TILE]) for at in range(0, len(payload), TILE)]
                    count.append(len(tiles))
                files = webpbatch.encode_many(tiles)
                media = [b"".join(files[a:b]) for a, b in zip([0, *count[:-1]], count, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def pixel_features(pixels: np.ndarray) -> str:
    """Size, sums of the channels and number of distinct samples."""
    sums = pixels.reshape(-1, 4).sum(0, dtype=np.int64)
    return f"{pixels.shape[1]}x{pixels.shape[0]};rgba={','.join(map(str, sums))};distinct={np.count_nonzero(np.bincount(pixels.ravel(), minlength=256))}"


def read_media(stored: DataFrame) -> DataFrame:
    """Decode every image of ``stored``: digests of the payload read back and of the media, and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            sizes, stored = batch.column(1).to_pylist(), batch.column(2)
            at = 0
            while at < batch.num_rows:  # as many rows as are decoded at once
                to, total = at + 1, sizes[at]
                while to < batch.num_rows and total + sizes[to] <= BATCH_BYTES:
                    total, to = total + sizes[to], to + 1
                media = [x.as_py() for x in stored[at:to]]
                files = [tiles_of(x) for x in media]
                decoded = iter(webpbatch.decode_many([f for x in files for f in x]))
                for size, one, tiles in zip(sizes[at:to], media, files, strict=True):
                    pixels = np.concatenate([next(decoded) for _ in tiles])
                    payload = pixels.reshape(-1)[: padded_size(size)].tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(one), hashlib.sha256(one).hexdigest(), pixel_features(pixels)))
                at = to
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, t) for x, t in zip(columns, types, strict=True)]], names)

    return stored.mapInArrow(read, schema)


def media_digests(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Store every text as an image in a table, read that table and digest what was read."""
    scratch = scratch or Scratch(docs.sparkSession, "media")
    return read_media(scratch.save(store_texts(docs), "media"))
