import pytest
from pyspark.sql import functions as F

from sievelight.config import Options
from sievelight.functions import scoring


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("target", "least"), [(0.8, 0.714285), (1.0, 1.0), (0.5, 0.285714), (0.2, 0.0)])
def test_least_question_share(target, least):
    assert Options(contamination_score_threshold=target).minimum_question_idf == pytest.approx(least, abs=1e-5)


def test_threshold_by_length(spark):
    at = lambda n, a, b: value(spark, scoring.threshold_by_length(F.lit(n), a, b, 0.8))
    assert [at(n, 20, 50) for n in (5, 20, 50, 80)] == [1, 1, 0.8, 0.8]
    assert at(35, 20, 50) == pytest.approx(0.9)
    assert [at(n, 20, None) for n in (20, 21)] == [1, 0.8]
    assert at(1, None, 50) == 0.8


@pytest.mark.parametrize("n", range(1, 25, 4))
@pytest.mark.parametrize("k", [1, 2, 3, 4, 9])
@pytest.mark.parametrize("parts", [(True, True), (True, False), (False, True), (False, False)])
def test_a_perfect_match_scores_one(spark, n, k, parts):
    base = scoring.base_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(n), F.lit(k), F.lit(parts[0]), F.lit(parts[1]))
    assert value(spark, scoring.final_score(base, F.lit(10), 20, 50, 0.8)) == pytest.approx(1, abs=1e-6)


def test_short_items_are_scaled_down(spark):
    assert value(spark, scoring.final_score(F.lit(0.9), F.lit(10), 20, 50, 0.8)) == pytest.approx(0.72)
    assert value(spark, scoring.final_score(F.lit(0.9), F.lit(60), 20, 50, 0.8)) == pytest.approx(0.9)
    assert value(spark, scoring.final_score(F.lit(0.9), F.lit(10), None, None, 0.8)) == pytest.approx(0.9)
