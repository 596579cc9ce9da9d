"""Eval datasets by configuration: every way to get prompts and answers."""

import gzip
import json

import pytest

from sievelight.operators import datasets


def rows_of(spark, tmp_path, examples, config, split="train"):
    path = tmp_path / "raw.jsonl"
    path.write_text("\n".join(json.dumps({"at": i, **x}) for i, x in enumerate(examples)))
    found = datasets.dataset_rows(spark.read.json(str(path)), "suite", config, split, index="at").orderBy("eval_instance_index", "place").collect()
    return [(r["eval_instance_index"], r["question"], r["answer"], r["sub_index"], r["is_correct"]) for r in found]


@pytest.mark.parametrize(
    ("example", "config", "wanted"),
    [
        ({"q": "Q", "a": {"text": ["x", "y"]}}, {"prompt": "q", "answers": ["a.text.1", "a.text.7"]}, [("Q", "y", None, None)]),
        ({"q": "Q", "a": {"u": "", "v": ""}, "b": 7}, {"prompt": "q", "answers": ["a", "b"]}, [("Q", "7", None, None)]),
        ({"q": "Q", "answer": {"date": {"month": "May", "day": "", "year": "1999"}}}, {"prompt": "q", "answers": ["answer.date"]}, [("Q", "May 1999", None, None)]),
        ({"q": "Q", "a": 0}, {"prompt": "q", "answers": [{"field": "a", "transform": "binary_to_bool"}]}, [("Q", "false", None, None)]),
        ({"q": "Q", "c": ["x", "y"], "k": "b"}, {"prompt": "q", "answers": [{"expand_choices": {"field": "c", "correct_index": "k"}}]}, [("Q", "x", None, False), ("Q", "y", None, True)]),
        ({"q": "Q", "c": ["x", "y"], "k": 0}, {"prompt": "q", "answers": [{"expand_choices": {"field": "c", "correct_index": "k"}}]}, [("Q", "x", None, True), ("Q", "y", None, False)]),
        ({"q": "Q", "c": {"text": ["x", "y"], "label": ["1", "2"]}, "k": "2"}, {"prompt": "q", "answers": [{"expand_choices": {"field": "c", "correct_index": "k"}}]}, [("Q", "x", None, False), ("Q", "y", None, True)]),
        ({"q": "Q", "c": ["x", "y"], "k": "1"}, {"prompt": "q", "answers": [{"indexed": {"field": "c", "key_field": "k"}}]}, [("Q", "y", None, None)]),
        ({"q": "Q", "sA": "x", "sB": "y", "k": "2"}, {"prompt": "q", "answers": [{"indexed": {"prefix": "s", "key_field": "k", "label_transform": "numbers_to_letters"}}]}, [("Q", "y", None, None)]),
        ({"q": "Q", "o1": "x", "o2": "y", "k": 1}, {"prompt": "q", "answers": [{"expand_prefix": {"prefix": "o", "suffix_match_field": "k", "label_transform": "add_one"}}]}, [("Q", "x", None, False), ("Q", "y", None, True)]),
        ({"q": "Q", "endinga": "x", "endingb": "y", "k": 0}, {"prompt": "q", "answers": [{"expand_prefix": {"prefix": "ending", "suffix_match_field": "k", "label_transform": "index_to_letter"}}]}, [("Q", "x", None, True), ("Q", "y", None, False)]),
        ({"q": "Q", "c": ["x", "y"], "k": "B"}, {"prompt": "q", "answer": {"field": "c", "key_field": "k"}}, [("Q", "y", None, None)]),
        ({"q": {"t": ["p", " ", "r"]}, "a": ["x", "y"]}, {"prompts": {"array": "q.t"}, "answers": [{"array": "a"}]}, [("p", "x", 0, None), ("r", None, 2, None)]),
        ({"m": [{"content": "p"}, {"content": None}, {"content": "r"}], "e": "end"}, {"prompt": {"concat_messages": {"field": "m"}, "append_field": "e"}}, [("p r end", None, None, None)]),
        ({"q": "Q", "a": " "}, {"prompt": {"field": "q"}, "answers": ["a", "missing"]}, [("Q", None, None, None)]),
        ({"q": " ", "a": "x"}, {"prompt": "q", "answers": ["a"]}, []),
    ],
)
def test_ways(spark, tmp_path, example, config, wanted):
    assert rows_of(spark, tmp_path, [example], config) == [(0, *w) for w in wanted]


def test_catalog_splits_bundled_files_and_hidden_answers(spark, tmp_path):
    (tmp_path / "local.jsonl").write_text('{"q": "one", "a": "x"}\n{"q": "two", "a": "y"}')
    (tmp_path / "bundled").mkdir()
    for name in ("own_train-1.jsonl.gz", "own_test-1.jsonl.gz", "other.jsonl.gz"):
        (tmp_path / "bundled" / name).write_bytes(gzip.compress(name.encode()))
    (tmp_path / "catalog.yaml").write_text(f"evals:\n  b:\n    local_path: bundled_evals/own_\n  l:\n    local_path: {tmp_path}/local.jsonl\n    splits: [train, test]\n    prompt: q\n    answers: [a]\n    no_answer_splits: [train]\n")
    written = {}
    made = datasets.build_datasets(spark, datasets.load_catalog(str(tmp_path / "catalog.yaml")), lambda df, name, split: written.update({(name, split): df.collect()}), bundled=str(tmp_path / "bundled"), path=str(tmp_path / "out"))
    assert made == {"b": ["b_test-1.jsonl.gz", "b_train-1.jsonl.gz"], "l": ["train"]}
    assert gzip.decompress((tmp_path / "out" / "b_test-1.jsonl.gz").read_bytes()) == b"own_test-1.jsonl.gz"
    assert [(r["question"], r["answer"], r["split"], len(r["fingerprint"])) for r in written["l", "train"]] == [("one", None, "train", 16), ("two", None, "train", 16)]
