"""Answers after, and passages before, a question's cluster: bounded searches in the document's tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.config import Options

SPANS = "array<struct<start:int,end:int>>"


def _gram(tokens: Column, at: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens, at + 1, n), " ")


def _positions(first: Column, last: Column) -> Column:
    """first..last, none if last is before."""
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def answer_window(total: Column, options: Options) -> Column:
    return F.when(total <= options.short_answer_token_threshold, options.short_answer_window_length).otherwise(F.greatest(2 * total, F.lit(options.min_long_answer_window)))


def passage_window(total: Column, options: Options) -> Column:
    return F.greatest(2 * total, F.lit(options.min_passage_distance))


def short_answer(tokens: Column, answer: Column, question_end: Column, options: Options) -> Column:
    """The first place in the window where the whole answer stands; only its start must be in the window."""
    size = F.size(answer)
    last = F.least(question_end + options.short_answer_window_length, F.size(tokens) - size)
    at = F.element_at(F.filter(_positions(question_end + 1, last), lambda i: F.slice(tokens, i + 1, size) == answer), 1)
    return F.when(at.isNotNull(), F.array(F.struct(at.alias("start"), (at + size - 1).alias("end"))))


def long_answer_hits(tokens: Column, ngrams: Column, window: Column, question_end: Column, options: Options) -> Column:
    """Places in the window whose n-gram is the answer's."""
    n = options.answer_ngram_size
    end = F.least(question_end + 1 + window, F.size(tokens))
    names = F.transform(ngrams, lambda g: g["ngram"])
    return F.filter(_positions(question_end + 1, end - n), lambda i: F.array_contains(names, _gram(tokens, i, n)))


def answer_ranges(hits: Column, n: int) -> Column:
    """Hits merged into ranges while the next starts at most n after the end."""
    start = F.array().cast(SPANS)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))

    def add(acc: Column, at: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (at <= F.coalesce(last["end"], F.lit(-(1 << 30))) + n)
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(span(last["start"], F.greatest(last["end"], at + n - 1))))
        return F.when(near, longer).otherwise(F.concat(acc, F.array(span(at, at + n - 1))))

    return F.aggregate(hits, start, add)


def weight_found(ngrams: Column, found: Column) -> Column:
    """Sum of the weights of those n-grams that were found."""
    return F.aggregate(F.filter(ngrams, lambda g: F.array_contains(found, g["ngram"])), F.lit(0.0), lambda a, g: a + g["idf"])


def grams_at(tokens: Column, places: Column, n: int) -> Column:
    return F.array_distinct(F.transform(places, lambda i: _gram(tokens, i, n)))


def passage_hits(tokens: Column, ngrams: Column, window: Column, question_start: Column, options: Options) -> Column:
    """Places before the question whose n-gram is the passage's, walking back until too many misses follow a hit."""
    n, most = options.passage_ngram_size, options.passage_max_consecutive_misses
    end = F.greatest(question_start - 1, F.lit(0))
    begin = F.greatest(end - window, F.lit(0))
    names = F.transform(ngrams, lambda g: g["ngram"])
    places = F.reverse(_positions(begin, end - n))
    none = F.struct(F.array().cast("array<int>").alias("hits"), F.lit(0).alias("missed"))

    def step(acc: Column, at: Column) -> Column:
        hit = F.array_contains(names, _gram(tokens, at, n))
        stopped = acc["missed"] > most
        return (
            F.when(stopped, acc)
            .when(hit, F.struct(F.concat(F.array(at), acc["hits"]).alias("hits"), F.lit(0).alias("missed")))
            .otherwise(F.struct(acc["hits"].alias("hits"), F.when(F.size(acc["hits"]) > 0, acc["missed"] + 1).otherwise(0).alias("missed")))
        )

    return F.aggregate(places, none, step, lambda acc: acc["hits"])


def share_of(found: Column, of: Column) -> Column:
    """Distinct tokens of ``of`` that are among the found, as a share."""
    distinct = F.array_distinct(of)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, found)) / F.size(distinct)).otherwise(0.0)
