"""Tokenizers by name: word (column expression), bytes, uniseg and BPE (Arrow batches)."""

from __future__ import annotations

import base64
import os
import warnings
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.matching import PIECE, bounds
from sievelight.functions.text import word_tokens

FOLDER = "/opt/tokenizers"
#: BPE names with the files of their vocabularies (ranks) in a folder; names without a file of their own here take ``<name>.tiktoken``.
VOCABULARIES = {"r50k": "byte_bpe_50k.tiktoken", "multi50k": "byte_bpe_multi_50k.tiktoken", "p50k": "p50k.tiktoken", "p50k_edit": "p50k_edit.tiktoken", "cl100k": "cl100k.tiktoken", "o200k": "o200k.tiktoken"}
#: How texts are cut into words before ranks are looked up: fixed values of the vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PATTERNS = {
    "cl100k": r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s",
    "o200k": "|".join(
        [
            r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?", r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
            r"\p{N}{1,3}", r" ?[^\s\p{L}\p{N}]+[\r\n/]*", r"\s*[\r\n]+", r"\s+(?!\S)", r"\s+",
        ]
    ),
}


@cache
def bpe(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoding_of(name: str, folder: str = FOLDER) -> tuple[str, str]:
    """Path and pattern of a BPE vocabulary; a known name whose file is not there is an error."""
    path = f"{folder}/{VOCABULARIES[name]}"
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary of {name}: {path}")
    return path, PATTERNS.get(name, PATTERN)


@cache
def vocabulary(name: str, folder: str = FOLDER) -> frozenset[int]:
    """Ids of a vocabulary's tokens that are white space only, found by decoding them."""
    encoding = bpe(*encoding_of(name, folder))
    return frozenset(i for i in range(encoding.n_vocab) if encoding.decode_single_token_bytes(i).decode("utf-8", "replace").isspace())


def blank_token(token: Column, name: str = "word", folder: str = FOLDER) -> Column:
    """Whether a token is a blank, which the token counts of filters leave out; words and segments never count as one."""
    if name in ("word", "uniseg"):
        return F.lit(False)
    return token.isin(sorted(vocabulary(name, folder)) if name in VOCABULARIES else [9, 10, 13, 32])


def tokenize(clean: Column, name: str = "word", folder: str = FOLDER) -> Column:
    """Tokens of a cleaned text, as strings or ids; an unknown name means bytes, with a warning."""
    if name == "word":
        return word_tokens(clean)
    if name == "uniseg":
        return _segments()(clean)
    if name in VOCABULARIES:
        return _ids(*encoding_of(name, folder))(clean)
    if name != "bytes":
        warnings.warn(f"unknown tokenizer {name!r}: bytes are used", stacklevel=2)
    return _bytes()(clean)


def _lists(texts: pa.Array, kind: pa.DataType, cut: Callable[[str], list]) -> Iterator[pa.Array]:
    """The token lists of texts, none of a null one, a bounded piece at a time: as Python's objects they are many times as large as the texts."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    for first, end in bounds(sizes, PIECE):
        yield pa.array([cut(t) if t else [] for t in texts.slice(first, end - first).to_pylist()], pa.list_(kind))


def _segments() -> Callable:
    @F.arrow_udf("array<string>")
    def segments(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        words = regex.compile(r"(?w)\b")
        for texts in batches:
            yield from _lists(texts, pa.string(), lambda t: [x for x in words.split(t) if x])

    return segments


def _bytes() -> Callable:
    @F.arrow_udf("array<bigint>")
    def utf8(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _lists(texts, pa.int64(), lambda t: list(t.encode()))

    return utf8


def _ids(path: str, pattern: str) -> Callable:
    @F.arrow_udf("array<bigint>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _lists(texts, pa.int64(), lambda t: bpe(path, pattern).encode_ordinary(" " + t))

    return ids


def decode(ids: Column, name: str, folder: str = FOLDER) -> Column:
    """Text of BPE ids or of UTF-8 bytes."""
    one = _decoder(name, folder)

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else one(list(r)))

    return text(ids)


def decode_each(lists: Column, name: str, folder: str = FOLDER) -> Column:
    """Texts of an array of token lists: words are joined by a blank, segments end to end, ids decoded."""
    if name in ("word", "uniseg"):
        return F.transform(lists, lambda x: F.array_join(x, " " if name == "word" else ""))
    one = _decoder(name, folder)

    @F.pandas_udf("array<string>")
    def texts(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else [one(list(x)) for x in r])

    return texts(lists)


def _decoder(name: str, folder: str) -> Callable[[list[int]], str]:
    if name in VOCABULARIES:
        path, pattern = encoding_of(name, folder)
        return lambda ids: bpe(path, pattern).decode(ids)
    return lambda ids: bytes(ids).decode("utf-8", "replace")
