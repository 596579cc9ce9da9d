"""Scores as column expressions, in double; a base score from 1 - 1e-6 counts as perfect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = 1 - 1e-6


def idf(total: Column, df: Column) -> Column:
    return F.log(total / df)


def threshold_by_length(length: Column, start: int | None, end: int | None, target: float) -> Column:
    """The threshold for a length: 1 up to start, target from end, linear between; a step where only start is set."""
    if start is None:
        return F.lit(target)
    if end is None:
        return F.when(length <= start, 1.0).otherwise(target)
    slope = F.lit(1.0) - (length - start) / max(1, end - start) * (1 - target)
    return F.when(length <= start, 1.0).when(length >= end, target).otherwise(slope)


def question_confidence(unique_ngrams: Column) -> Column:
    return F.when(unique_ngrams < 20, 0.5 + 0.5 * unique_ngrams / 20).otherwise(1.0)


def answer_confidence(unique_tokens: Column) -> Column:
    return F.when(unique_tokens < 4, 0.5 + 0.5 * unique_tokens / 4).otherwise(1.0)


def base_score(q: Column, a: Column, p: Column, unique_ngrams: Column, answer_tokens: Column, has_answer: Column, has_passage: Column) -> Column:
    """Weighted overlaps; what little confidence takes from the question goes to answer and passage."""
    a, p = F.coalesce(a, F.lit(0.0)), F.coalesce(p, F.lit(0.0))
    cq, ca = question_confidence(unique_ngrams), answer_confidence(F.coalesce(answer_tokens, F.lit(4)))
    lost = (1 - cq) * 0.7
    for_answer, for_passage = 0.2 + lost / 2, 0.1 + lost / 2
    all_three = F.when((cq < 1) | (ca < 1), q * (0.7 * cq) + a * (for_answer * ca) + p * (for_passage + for_answer * (1 - ca))).otherwise(q * 0.7 + a * 0.2 + p * 0.1)
    return (
        F.when(has_answer & has_passage, all_three)
        .when(has_answer, q * (0.75 * cq) + a * (0.25 + 0.75 * (1 - cq)))
        .when(has_passage, q * (0.85 * cq) + p * (0.15 + 0.85 * (1 - cq)))
        .otherwise(q)
    )


def final_score(base: Column, length: Column, start: int | None, end: int | None, target: float) -> Column:
    """Capped at 1, and scaled down where a short item needs more than the target; a perfect score stays 1."""
    s = F.least(base, F.lit(1.0))
    if start is None and end is None:
        return s
    need = threshold_by_length(length, start, end, target)
    k = target / need
    return F.when(need > target, s * k + F.when(s >= EXACT, 1 - k).otherwise(0.0)).otherwise(s)


def assessment(score: Column) -> Column:
    return F.when(score >= 1, "exact").when(score > 0.9, "very likely").when(score > 0.8, "likely").when(score > 0.7, "possible").otherwise("unlikely")
