import gzip
import json
import lzma

import pytest
from pyspark.sql import functions as F

from sievelight.config import Options
from sievelight.operators import compare, normalize, spans
from sievelight.operators.clusters import walk, walked_clusters
from sievelight.operators.index import build_index
from sievelight.plans import detect as plan
from sievelight.sources import jsonl, sinks

LAX = Options(eval_min_token_length=0, eval_min_unique_word_count=0)
WORDS = [f"w{i}" for i in range(400)]
QUESTION, ANSWER, PASSAGE = " ".join(WORDS[:30]), " ".join(WORDS[50:58]), " ".join(WORDS[100:130])
SCHEMA = "eval_id long, eval_key string, eval_line long, eval_instance_index long, fingerprint string, question string, answer string, passage string"


def index_of(spark, rows, options=LAX):
    return build_index(spark.createDataFrame([(i, k, i, n, f, q, a, p) for i, (k, n, f, q, a, p) in enumerate(rows)], SCHEMA), options)


def docs_of(spark, *texts):
    return spark.createDataFrame([(i, t, "f", i) for i, t in enumerate(texts)], "doc_id long, text string, training_file string, training_line long")


OTHERS = [("other", 7, None, " ".join(WORDS[300:330]), None, None)]


def test_verbatim_edited_and_clean_documents(spark):
    index = index_of(spark, [("a", 1, None, QUESTION, None, None), *OTHERS])
    edited = QUESTION.replace("w15", "changed")
    clean = " ".join(WORDS[200:260])
    docs = docs_of(spark, f"before {QUESTION} after", f"x {edited} y " + clean, clean, "short text", None)
    found = {(r["doc_id"], r["eval_id"]): r for r in plan.detect(docs, index).collect()}
    assert set(found) >= {(0, 0)} and all(d in (0, 1) for d, _ in found)
    assert found[0, 0]["contamination_score"] == pytest.approx(1.0)
    assert (found[0, 0]["start"], found[0, 0]["end"]) == (1, 26)
    assert {r["doc_id"] for r in plan.purify(docs, plan.detect(docs, index)).collect()} >= {2, 3, 4}


def test_gap_of_eleven_joins_and_twelve_parts(spark):
    index = index_of(spark, [("a", 1, None, QUESTION, None, None), *OTHERS])
    head, tail = WORDS[:10], WORDS[10:20]
    from sievelight.operators.clusters import gap_clusters, probe, training_tokens

    for fill, parts in ((6, 1), (7, 2)):  # places of hits 11 and 12 apart
        docs = docs_of(spark, " ".join([*head, *(f"z{i}" for i in range(fill)), *tail]))
        assert gap_clusters(probe(training_tokens(docs, LAX), index), LAX).count() == parts


def test_answers_and_passages(spark):
    index = index_of(spark, [("a", 1, None, QUESTION, ANSWER, PASSAGE), ("s", 2, None, " ".join(WORDS[60:90]), "w95 w96", None), *OTHERS])
    whole = f"{PASSAGE} so {QUESTION} then {ANSWER} end"
    apart = f"{QUESTION} then nothing of the kind comes after it here"
    short = f"{' '.join(WORDS[60:90])} the answer is w95 w96 of course"
    rows = {(r["doc_id"], r["eval_id"]): r for r in plan.scored(_spans(docs_of(spark, whole, apart, short), index), index).collect()}
    full, bare, brief = rows[0, 0], rows[1, 0], rows[2, 1]
    assert full["contamination_score"] == pytest.approx(1, abs=0.03)
    assert full["answer_idf_overlap"] == pytest.approx(1) and full["answer_boundaries"][0]["start"] == 62
    # the token right before the question is outside the window
    assert full["passage"]["start"] == 0 and full["passage_idf_overlap"] == pytest.approx(1)
    assert bare["answer_boundaries"] is None and bare["answer_idf_overlap"] == 0 and bare["passage_idf_overlap"] == 0
    assert [tuple(s) for s in brief["answer_boundaries"]] == [(33, 34)] and brief["answer_idf_overlap"] == 1


def _spans(docs, index):
    tokens, passed = plan.candidates(docs, index)
    return plan.with_passages(plan.with_answers(passed.join(tokens.select("doc_id", "tokens"), "doc_id"), index), index)


def test_competing_answers_leave_one_match(spark):
    rows = [("a", 1, str(i), QUESTION, f"w{200 + i} w{210 + i} w{220 + i} w{230 + i} w{240 + i}", None) for i in range(3)]
    found = plan.detect(docs_of(spark, f"x {QUESTION} y w201 w211 w221 w231 w241 z"), index_of(spark, [*rows, *OTHERS])).collect()
    assert [(r["eval_id"], r["answer_idf_overlap"]) for r in found] == [(1, pytest.approx(1))]


def test_eval_dedup_by_fingerprint(spark):
    rows = [("a", 1, "f", QUESTION, None, None), ("a", 2, "f", QUESTION, None, None), ("b", 3, "f", QUESTION, None, None), ("a", 4, None, QUESTION, None, None), ("a", 5, None, QUESTION, None, None), ("a", 6, "g", "", None, None)]
    assert sorted(r["eval_id"] for r in index_of(spark, rows).evals.collect()) == [0, 2, 3, 4]


def test_one_row_has_no_weight(spark):
    assert plan.detect(docs_of(spark, f"x {QUESTION} y"), index_of(spark, [("a", 1, None, QUESTION, None, None)])).count() == 0


def test_hot_ngrams_do_not_seed(spark):
    options = Options(eval_min_token_length=0, eval_min_unique_word_count=0, hot_threshold=1)
    index = index_of(spark, [("a", 1, None, QUESTION, None, None), ("a", 2, None, QUESTION, None, None), *OTHERS], options)
    assert plan.detect(docs_of(spark, f"x {QUESTION} y"), index).count() == 0


def test_walk_by_hand():
    grams = [f"g{i}" for i in range(40)]
    postings = {f"g{i}": (False, frozenset([1])) for i in (10, 11, 12, 23)} | {"g20": (True, frozenset([2]))}
    assert walk(grams, postings, 10, 11) == [(0, 1, 10, 23, ["g10", "g11", "g12", "g23"])]
    assert walk(grams, postings, 10, 10)[0][2:4] == (10, 12)
    assert walk(grams, postings, 7, 11)[0][2:4] == (10, 23) if walk(grams, postings, 7, 11) else True
    assert walk([], postings, 10, 11) == []


def test_walk_finds_no_more_than_gaps(spark):
    index = index_of(spark, [("a", 1, None, QUESTION, None, None), *OTHERS])
    docs = docs_of(spark, f"before {QUESTION} after", " ".join(WORDS[200:240]) + " " + QUESTION)
    tokens, _ = plan.candidates(docs, index)
    walked = {(r["doc_id"], r["eval_id"]) for r in walked_clusters(tokens, index).collect()}
    assert walked == {(0, 0), (1, 0)}
    assert plan.detect(docs, index, walked=True).count() == 2


def test_answer_ranges(spark):
    merged = lambda hits, n: [tuple(s) for s in spark.range(1).select(spans.answer_ranges(F.array(*[F.lit(h) for h in hits]), n)).first()[0]]
    assert merged([6, 7, 8], 3) == [(6, 10)]
    assert merged([6, 8, 17], 3) == [(6, 10), (17, 19)]
    assert merged([6, 13], 3) == [(6, 8), (13, 15)] and merged([6, 11], 3) == [(6, 13)]


def test_jsonl_sources_and_sinks(spark, tmp_path):
    lines = ['{"text": "one two"}', "broken", '{"text": 7}', '{"no": 1}', "", '{"text": "three"}']
    body = "\n".join(lines) + "\n"
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_text(body)
    (tmp_path / "in" / "b.jsonl.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "in" / "deep" / "c.jsonl.xz").write_bytes(lzma.compress(body.encode()))
    docs = jsonl.training_documents(spark, str(tmp_path / "in"))
    assert sorted((r["training_line"], r["text"]) for r in docs.collect()) == [(0, "one two")] * 3 + [(5, "three")] * 3
    hits = docs.where("training_line = 5").select("training_file", "training_line")
    sinks.write_purified(jsonl.text_lines(spark, str(tmp_path / "in")).where("training_file LIKE '%a.jsonl'"), hits, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out"), recursiveFileLookup=True).collect()] == lines[:5]
    evals = ['# comment', json.dumps({"doc_id": 1, "question": "q"}), json.dumps({"question": "no id"}), json.dumps({"doc_id": 2, "eval_name": "n", "question": "r", "answer": "a"})]
    (tmp_path / "evals").mkdir()
    (tmp_path / "evals" / "suite.jsonl").write_text("\n".join(evals))
    rows = sorted((r["doc_id"], r["eval_key"], r["eval_line"]) for r in jsonl.eval_documents(spark, str(tmp_path / "evals")).collect())
    assert rows == [(1, "suite", 1), (2, "n", 3)]


def test_reports_round_trip(spark, tmp_path):
    index = index_of(spark, [("a", 1, "f", QUESTION, ANSWER, None), *OTHERS])
    docs = docs_of(spark, f"x {QUESTION} so {ANSWER} y")
    report = plan.report(plan.detect(docs, index), docs, index)
    sinks.write_reports(report, str(tmp_path / "reports"))
    back = jsonl.read_reports(spark, str(tmp_path / "reports")).first()
    assert (back["training_file"], back["eval_dataset"], back["eval_line"], back["fingerprint"]) == ("f", "a", 0, "f")
    assert back["eval_passage_text"] is None and "【" in back["training_overlap_text"]


def test_compare_runs(spark):
    schema = "training_file string, training_line long, eval_dataset string, eval_line long, eval_instance_index long, contamination_score double, fingerprint string"
    one = spark.createDataFrame([("f", 1, "a", 1, 1, 0.9, "x"), ("f", 2, "a", 1, 1, 0.8, "y"), ("f", 2, "a", 1, 2, 0.7, "y")], schema)
    two = spark.createDataFrame([("f", 1, "a", 1, 1, 0.8, "x"), ("g", 1, "b", 1, 1, 1.0, "z")], schema)
    assert compare.only_in(one, two).count() == 1 and compare.only_in(two, one).first()["training_file"] == "g"
    assert compare.score_changes(one, two).first()[:3] == (1, 0, 0)
    assert {r["eval_dataset"]: r["delta"] for r in compare.suite_deltas(one, two).collect()} == {"a": -2, "b": 1}
    assert [r["fingerprint"] for r in compare.fingerprints_only_in(one, two).collect()] == ["y"]


def test_normalization(spark):
    rows = spark.createDataFrame([(["p", "q"], "B", {"text": ["p", "q"], "label": ["1", "2"]}, "2", 0)], "c array<string>, k string, l struct<text:array<string>,label:array<string>>, lk string, b int")
    assert [(r["answer"], r["is_correct"]) for r in normalize.expand_choices(rows, "c", "k").collect()] == [("p", False), ("q", True)]
    assert [(r["answer"], r["is_correct"]) for r in normalize.expand_labelled(rows, "l", "lk").collect()] == [("p", False), ("q", True)]
    assert normalize.indexed(rows, "c", "b").first()["answer"] == "p" and normalize.indexed(rows.withColumn("k", F.lit("9")), "c", "k").first()["answer"] is None
    assert rows.select(normalize.binary_to_bool(F.col("b"))).first()[0] == "false"
    date = spark.sql("SELECT named_struct('month', 'May', 'day', '', 'year', '1999') AS d")
    assert date.select(normalize.date_answer(F.col("d"))).first()[0] == "May 1999"
    messages = spark.sql("SELECT array(named_struct('content', 'a'), named_struct('content', 'b')) AS m")
    assert messages.select(normalize.concat_messages(F.col("m"), F.lit("c"))).first()[0] == "a b c"


def test_entry_without_the_training_data_package(tmp_path):
    """The rest imports when that package and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "sievelight", tmp_path / "sievelight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) >= 60
