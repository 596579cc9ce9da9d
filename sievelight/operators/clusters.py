"""Clusters of n-gram hits: by gaps over all hits, or by the sampled, sequential walk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.config import Options
from sievelight.functions.matching import pieces
from sievelight.functions.text import clean_text, shingles
from sievelight.functions.tokenizers import tokenize
from sievelight.operators.index import Index, ordered_sum


def training_tokens(docs: DataFrame, options: Options) -> DataFrame:
    """``docs`` (doc_id, text, ...) with clean text and tokens; those of fewer than two n-grams' tokens go."""
    # as a generator's row a text is cleaned once; else the filter below, which Spark moves down, cleans it again
    once = F.inline(F.array(F.struct(clean_text(F.col("text"), options.punctuation_chars).alias("clean"))))
    clean = docs.where("text IS NOT NULL").select(*[F.col(f"`{c}`") for c in docs.columns if c != "clean"], once)
    return clean.withColumn("tokens", tokenize(F.col("clean"), options.tokenizer)).where(F.size("tokens") >= 2 * options.ngram_size)


def training_ngrams(tokens: DataFrame, n: int) -> DataFrame:
    """doc_id, pos and ngram of every position."""
    return tokens.select("doc_id", F.posexplode(shingles(F.col("tokens"), n)).alias("pos", "ngram"))


def hit_documents(tokens: DataFrame, index: Index, *others: Index) -> DataFrame:
    """doc_id, tokens and hits (pos and ngram) of the documents of ``tokens`` (doc_id, tokens) in which some n-gram of a small index, or of others like it, may occur.

    More than 99 of 100 n-grams miss: only documents with hits are written out of the scan, and only
    their tokens are shuffled, by doc_id. Who reads this more than once should persist it: Spark
    takes other columns for each use, and so scans all documents again.
    """
    n = index.options.ngram_size
    sent = tokens.sparkSession.sparkContext.broadcast(index.ngram_set(*others))
    element = tokens.schema["tokens"].dataType.elementType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            owner, pos = sent.value.find(batch.column(1))
            if not len(owner):
                continue
            rows, first = np.unique(owner, return_index=True)
            lists = batch.column(1).take(pa.array(rows))
            words = {int(r): x.as_py() for r, x in zip(rows, lists, strict=True)}
            grams = [" ".join(map(str, words[r][p : p + n])) for r, p in zip(owner.tolist(), pos.tolist(), strict=True)]
            hits = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(grams, pa.string())], ["pos", "ngram"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists, pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)), pa.int32()), hits)], ["doc_id", "tokens", "hits"])

    found = tokens.select("doc_id", "tokens").mapInArrow(find, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, tokens array<{element}>, hits array<struct<pos:int,ngram:string>>")
    return found.repartition("doc_id")


def probe(tokens: DataFrame, index: Index) -> DataFrame:
    """Hits: doc_id, eval_id, pos, ngram, idf and is_hot; an index that is not small meets the n-grams in a shuffle, where its postings lie by n-gram already."""
    if not index.small:
        return training_ngrams(tokens, index.options.ngram_size).join(index.postings.select("ngram", "eval_id", "idf", "is_hot"), "ngram")
    return hits_of(hit_documents(tokens, index), index)


def ngram_key() -> tuple[Column, Column]:
    """Two 64-bit hashes of the n-gram: a third of the bytes of its text."""
    return F.xxhash64("ngram").alias("key1"), F.xxhash64(F.lit(1), F.col("ngram")).alias("key2")


def needed_postings(index: Index, need: Column) -> DataFrame:
    """eval_id and ngram of the rarest n-grams of each eval row, as many as every cluster with a share of ``need`` of the row's weight has one of: the others weigh less."""
    rows = index.postings.join(index.stats.select("eval_id", need.alias("need"), F.col("question_idf_sum").alias("total")), "eval_id")
    others = F.sum("idf").over(Window.partitionBy("eval_id").orderBy(F.col("idf"), F.desc("ngram")))
    # sums in another order differ in their last digits
    return rows.withColumn("others", others).where(F.col("others") >= (F.col("need") - 1e-6) * F.col("total")).select("eval_id", "ngram")


def needed_hits(tokens: DataFrame, index: Index, need: Column) -> DataFrame:
    """The hits, as of ``probe``, of documents and eval rows that share a needed n-gram: for an index that is not small, where n-grams that many rows share would make hits with their square."""
    grams = training_ngrams(tokens, index.options.ngram_size).select("doc_id", "pos", *ngram_key())
    needed = needed_postings(index, need).select("eval_id", *ngram_key())
    pairs = grams.join(needed, ["key1", "key2"]).select("doc_id", "eval_id").distinct()
    wanted = pairs.join(index.postings.select("eval_id", "ngram", "idf", "is_hot", *ngram_key()), "eval_id")
    return grams.join(wanted, ["doc_id", "key1", "key2"]).drop("key1", "key2")


def hits_of(found: DataFrame, index: Index) -> DataFrame:
    """The hits of documents found, with the eval rows that have the very n-gram."""
    hits = found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.pos", "hit.ngram")
    return hits.join(index.near(index.postings.select("ngram", "eval_id", "idf", "is_hot")), "ngram")


def gap_clusters(hits: DataFrame, options: Options) -> DataFrame:
    """Hits of a document and an eval row at most ``question_max_consecutive_misses`` apart are one cluster; it needs an n-gram that is not hot."""
    order = Window.partitionBy("doc_id", "eval_id").orderBy("pos")
    fresh = F.when(F.col("pos") - F.lag("pos").over(order) <= options.question_max_consecutive_misses, 0).otherwise(1)
    numbered = hits.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(order))
    by_ngram = numbered.groupBy("doc_id", "eval_id", "cluster", "ngram").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("idf").alias("idf"), F.first("is_hot").alias("is_hot"))
    found = by_ngram.groupBy("doc_id", "eval_id", "cluster").agg(
        F.min("lo").alias("start"), F.max("hi").alias("end"), F.count("*").alias("ngram_match_cnt"), ordered_sum(F.col("idf")).alias("matched_idf"), F.min("is_hot").alias("all_hot")
    )
    return found.where("not all_hot").drop("all_hot")


def walk(grams: list[str], postings: dict[str, tuple[bool, frozenset]], every: int, misses: int) -> list[tuple[int, int, int, int, list[str]]]:
    """(cluster, eval_id, start, end, n-grams) by the sampled walk over one document's n-grams.

    A hit on an n-gram that is not hot seeds a cluster of its eval rows; from there it walks left
    and right. A row is dropped after ``misses`` misses, which only an n-gram new to it resets;
    every match extends its bounds. The scan goes on after the right end.
    """
    out, i, number = [], 0, 0
    while i < len(grams):
        seed = postings.get(grams[i])
        if seed is None:
            i += every
            continue
        if seed[0]:
            i += 1
            continue
        matched = {d: {grams[i]} for d in seed[1]}
        bounds = {d: [i, i] for d in seed[1]}
        ends = []
        for side, step in ((0, -1), (1, 1)):
            active, missed, at = set(seed[1]), dict.fromkeys(seed[1], 0), i
            while active and 0 <= at + step < len(grams):
                at += step
                found = postings.get(grams[at], (False, frozenset()))[1]
                for d in [*active]:
                    if d in found:
                        bounds[d][side] = at
                        if grams[at] not in matched[d]:
                            matched[d].add(grams[at])
                            missed[d] = 0
                    else:
                        missed[d] += 1
                        if missed[d] >= misses:
                            active.discard(d)
            ends.append(at)
        out += [(number, d, *bounds[d], sorted(matched[d])) for d in sorted(matched)]
        number += 1
        i = max(i, ends[1] + 1)
    return out


#: Columns of the walk's clusters.
WALKED = pa.schema([("doc_id", pa.int64()), ("eval_id", pa.int64()), ("cluster", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("ngram_match_cnt", pa.int64()), ("matched_idf", pa.float64())])


def walked_clusters(tokens: DataFrame, index: Index) -> DataFrame:
    """Clusters by the sampled walk, one document with hits at a time. The postings go to every executor, so the index must be small."""
    if not index.small:
        raise ValueError("the sampled walk needs an index that can be broadcast")
    options = index.options
    table: dict[str, tuple[bool, set, float]] = {}
    for row in index.postings.toLocalIterator():
        table.setdefault(row["ngram"], (row["is_hot"], set(), row["idf"]))[1].add(row["eval_id"])
    sent = tokens.sparkSession.sparkContext.broadcast({g: (hot, frozenset(ids), weight) for g, (hot, ids, weight) in table.items()})
    n, every, misses = options.ngram_size, options.sample_every_m_tokens, options.question_max_consecutive_misses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        postings = {g: v[:2] for g, v in weights.items()}
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            rows = []
            for doc_id, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = [" ".join(map(str, words[i : i + n])) for i in range(len(words) - n + 1)]
                rows += [(doc_id, d, number, a, b, len(found), sum(weights[g][2] for g in found)) for number, d, a, b, found in walk(grams, postings, every, misses)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(WALKED), WALKED, strict=True)], schema=WALKED)

    # a document without a hit has no cluster
    return hit_documents(tokens, index).select("doc_id", "tokens").mapInArrow(run, "doc_id long, eval_id long, cluster long, start int, end int, ngram_match_cnt long, matched_idf double")
