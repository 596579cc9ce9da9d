"""Token n-gram matching, tokenizers, highlights, sinks and the file stream."""

import bz2
import gzip
import json
import lzma
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.config import Options

from sievelight.functions import matching, text, tokenizers
from sievelight.functions.matching import NgramSet
from sievelight.operators import clusters, compare, counts, review
from sievelight.operators.index import build_index
from sievelight.plans import detect as plan
from sievelight.sources import jsonl, sinks
from sievelight.streaming.detect import process_folder
from tests.test_detect import ANSWER, LAX, OTHERS, PASSAGE, QUESTION, WORDS, docs_of, index_of


@pytest.mark.parametrize("kind", [pa.string(), pa.int64()])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_ngrams_are_found_where_they_are(kind, n):
    rng = random.Random(n)
    make = lambda size: [x if kind == pa.int64() else f"t{x}" for x in (rng.randrange(4) for _ in range(size))]
    known, lists = [make(k) for k in (0, n - 1, n, n + 3, 9)], [make(rng.randrange(12)) for _ in range(60)] + [None, []]
    found = NgramSet.of(pa.array(known, pa.list_(kind)), n).find(pa.array(lists, pa.list_(kind)))
    grams = {tuple(k[i : i + n]) for k in known for i in range(len(k) - n + 1)}
    assert list(zip(*(x.tolist() for x in found), strict=True)) == [(i, p) for i, x in enumerate(lists) for p in range(len(x or []) - n + 1) if tuple(x[p : p + n]) in grams]
    assert len(NgramSet.of(pa.array([], pa.list_(kind)), n).find(pa.array(lists, pa.list_(kind)))[0]) == 0


def test_a_large_index_gives_the_same_matches(spark, monkeypatch):
    from sievelight.operators import index as module

    rows = [("a", 1, None, QUESTION, ANSWER, PASSAGE), *OTHERS]
    docs = docs_of(spark, f"{PASSAGE} so {QUESTION} then {ANSWER} end", " ".join(WORDS[200:260]), f"x {QUESTION} y")
    found = lambda: sorted((r["doc_id"], r["eval_id"], r["contamination_score"]) for r in plan.detect(docs, index_of(spark, rows)).collect())
    small = found()
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    assert found() == small and {d for d, *_ in small} == {0}


def test_tokenizers_that_are_not_there(spark):
    clean = F.lit("hello world")
    with pytest.raises(FileNotFoundError, match="cl100k"):
        tokenizers.tokenize(clean, "cl100k")
    with pytest.warns(UserWarning, match="unknown"):
        assert spark.range(1).select(tokenizers.tokenize(F.lit("abc"), "nothing")).first()[0] == [97, 98, 99]
    assert spark.range(1).select(tokenizers.tokenize(F.lit("hello world"), "uniseg")).first()[0] == ["hello", " ", "world"]
    ids = spark.range(1).select(tokenizers.tokenize(clean, "r50k")).first()[0]
    assert len(ids) == 2 and spark.range(1).select(tokenizers.decode(F.array(*map(F.lit, ids)), "r50k")).first()[0] == " hello world"


def test_blank_tokens_do_not_count(spark):
    blank = tokenizers.vocabulary("r50k")
    assert {*range(197, 202), *range(216, 221), 628, 1849} <= blank and 995 not in blank
    raw = spark.createDataFrame([(1, "ab cd"), (2, "abcde")], "eval_id long, question string")
    kept = lambda least: sorted(r["eval_id"] for r in build_index(raw, Options(tokenizer="bytes", eval_min_token_length=least, eval_min_unique_word_count=0)).evals.collect())
    assert kept(4) == [1, 2] and kept(5) == [2] and kept(6) == []


@pytest.mark.parametrize("name", ["word", "uniseg", "bytes", "r50k"])
def test_highlights_are_text(spark, name):
    options = Options(eval_min_token_length=0, eval_min_unique_word_count=0, tokenizer=name)
    index = index_of(spark, [("a", 1, "f", QUESTION, ANSWER, PASSAGE), *OTHERS], options)
    docs = docs_of(spark, f"before it {PASSAGE} so {QUESTION} then {ANSWER} end of the document")
    shown = [r["training_overlap_text"] for r in plan.report(plan.detect(docs, index), docs, index).where("eval_line = 0").collect()]
    assert shown and all("【" in x and "w5 w6 w7" in x and "2124" not in x for x in shown)
    if name == "word":
        assert shown == [f"⟨{PASSAGE}⟩ so 【{QUESTION}】 then ⟦{ANSWER}⟧ end of the document ..."]


def test_several_answers_and_terminal_colours(spark):
    tokens = F.split(F.lit("a b c d e f g h i j"), " ")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((4, 4), (7, 8))])
    none = F.lit(None).cast("struct<start:int,end:int>")
    pieces = text.highlight_pieces(tokens, F.lit(1), F.lit(2), none, spans)
    shown = text.marked(pieces, tokenizers.decode_each(F.transform(pieces, lambda p: p["tokens"]), "word"), " ")
    row = spark.range(1).select(shown.alias("s")).select("s", text.ansi_highlight(F.col("s")).alias("c"), text.thousands(F.lit(1234567)).alias("n")).first()
    assert row["s"] == "... a 【b c】 d ⟦e⟧ f g ⟦h i⟧ j ..." and row["c"].count("\033[0m") == 3 and row["n"] == "1,234,567"


def test_nested_keys_with_places(spark):
    raw = F.lit('{"a": [{"b": "x"}, {"b": 1}]}')
    one = lambda key: spark.range(1).select(text.nested_text(raw, key)).first()[0]
    assert one("a.0.b") == "x" and one("a.1.b") is None and one("a.7.b") is None
    row = spark.sql("SELECT named_struct('c', array('p', 'q')) AS s")
    assert row.select(text.nested_field(F.col("s"), "c.1"), text.nested_field(F.col("s"), "c.5")).first()[:] == ("q", None)


LINES = ['{"text": "one two"}', "broken", '{"text": 7}', '{"no": 1}', "", '{"text": "three"}']


def write_inputs(folder):
    import zstandard

    body = ("\r\n".join(LINES) + "\n").encode()
    (folder / "deep").mkdir(parents=True)
    (folder / "a.jsonl").write_bytes(body)
    (folder / "b.jsonl.gz").write_bytes(gzip.compress(body))
    (folder / "c.json.bz2").write_bytes(bz2.compress(body))
    (folder / "deep" / "d.jsonl.zst").write_bytes(zstandard.compress(body))
    (folder / "deep" / "e.jsonl.xz").write_bytes(lzma.compress(body))


def test_every_compression_and_line_numbers_over_splits(spark, tmp_path):
    write_inputs(tmp_path / "in")
    docs = jsonl.training_documents(spark, str(tmp_path / "in")).collect()
    assert sorted((r["training_file"].rpartition("/")[2], r["training_line"], r["text"]) for r in docs) == sorted((f, i, t) for f in ("a.jsonl", "b.jsonl.gz", "c.json.bz2", "d.jsonl.zst", "e.jsonl.xz") for i, t in ((0, "one two"), (5, "three")))
    assert len({r["doc_id"] for r in docs}) == 10
    (tmp_path / "large").mkdir()
    (tmp_path / "large" / "x.jsonl").write_text("".join(json.dumps({"text": f"line {i}"}) + "\n" for i in range(5_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = jsonl.text_lines(spark, str(tmp_path / "large"))
        assert sorted((r["training_line"], json.loads(r["raw"])["text"]) for r in lines.collect()) == [(i, f"line {i}") for i in range(5_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sinks_have_the_inputs_tree_and_empty_files(spark, tmp_path, monkeypatch):
    write_inputs(tmp_path / "in")
    base = str(tmp_path / "in")
    lines = jsonl.text_lines(spark, base)
    hits = lines.where("training_file LIKE '%a.jsonl' OR (training_file LIKE '%zst' AND training_line < 5)").select("training_file", "training_line")
    names = sinks.write_purified(lines, hits, str(tmp_path / "out"), base=base)
    assert sorted(names) == ["a.jsonl.gz", "b.jsonl.gz", "c.json.jsonl.gz", "deep/d.jsonl.gz", "deep/e.jsonl.gz"]
    read = lambda n: gzip.decompress((tmp_path / "out" / n).read_bytes()).decode().splitlines()
    assert read("a.jsonl.gz") == [] and read("b.jsonl.gz") == LINES and read("deep/d.jsonl.gz") == LINES[5:]
    monkeypatch.setattr(sinks, "PART_LINES", 4)
    sinks.write_purified(lines, hits, str(tmp_path / "parts"), base=base)
    parts = sorted(p.name for p in (tmp_path / "parts" / "deep").glob("e*.gz"))
    assert parts == ["e-00001.jsonl.gz", "e-00002.jsonl.gz"] and sum((gzip.decompress((tmp_path / "parts" / "deep" / p).read_bytes()).decode().splitlines() for p in parts), []) == LINES
    assert sinks.report_name("file:/x/in/deep/d.jsonl.zst", "/x/in", 0.8) == "deep/d.jsonl-simple-0.80.jsonl" and sinks.report_name("/y/d.jsonl", "/x/in", 0.55) == "d-simple-0.55.jsonl"


def test_eval_files_and_chunks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", f"question {i}", "x" * 50) for i in range(40)], "eval_key string, split string, question string, answer string")
    sinks.write_evals(rows, str(tmp_path / "evals"), chunk_bytes=1_000)
    files = [p for p in (tmp_path / "evals" / "eval_key=a" / "split=train").iterdir() if p.name.endswith(".json.gz")]
    assert len(files) > 3 and all(len(json.loads(x)["fingerprint"]) == 16 for p in files for x in gzip.decompress(p.read_bytes()).decode().splitlines())
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.jsonl").write_text('{"eval_key": "a", "question": "four"}\n\nbroken\n{"question": "no key"}\n{"eval_key": " "}\n{"eval_key": "a", "question": "é", "answer": " "}\n')
    got = jsonl.eval_files_statistics(spark, str(tmp_path / "s")).first()
    assert (got["eval_key"], got["n_rows"], got["n_question"], got["min_question"], got["max_question"], got["n_answer"], got["skipped_rows"]) == ("a", 2, 2, 2, 4, 0, 2)


def test_a_folder_is_processed_once_and_goes_on(spark, tmp_path):
    index = index_of(spark, [("a", 1, None, QUESTION, None, None), *OTHERS])
    source, uploaded = tmp_path / "in", []
    source.mkdir()
    put = lambda name, *texts: (source / name).write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
    put("a.jsonl", f"x {QUESTION} y", "clean " * 20)
    run = lambda: process_folder(spark, str(source), index, str(tmp_path / "reports"), str(tmp_path / "checkpoint"), cleaned=str(tmp_path / "cleaned"), upload=uploaded.append).awaitTermination()
    run()
    put("b.jsonl", "other " * 20)
    run()
    assert uploaded == [["a-simple-0.80.jsonl", "a.jsonl.gz"], ["b.jsonl.gz"]]
    assert [r["training_line"] for r in jsonl.read_reports(spark, str(tmp_path / "reports")).collect()] == [0]
    assert gzip.decompress((tmp_path / "cleaned" / "a.jsonl.gz").read_bytes()).decode().count("\n") == 1


def test_counters(spark):
    index = index_of(spark, [("a", 1, None, QUESTION, ANSWER, PASSAGE), *OTHERS])
    counters = {}
    found = plan.detect(docs_of(spark, f"x {QUESTION} y", f"{PASSAGE} so {QUESTION} then {ANSWER} end"), index, counters=counters)
    assert found.count() >= 1
    assert counters["candidates"].get == {"n": 2, "no_answer": 1, "no_passage": 1} and counters["matches"].get["n"] >= 1


def test_comparison_groups_and_ranks(spark):
    schema = "training_file string, training_line long, eval_dataset string, eval_line long, eval_instance_index long, contamination_score double, fingerprint string, eval_question_text string"
    one = spark.createDataFrame([("f", 1, "a", 1, 1, 0.9, "x", "t"), ("f", 2, "a", 1, 1, 0.8, "y", "t"), ("g", 3, "a", 1, 2, 0.7, "y", "t"), ("h", 4, "b", 5, 2, 0.9, "z", "u"), (None, 4, "b", 5, 2, 0.9, None, None)], schema)
    two = one.where("fingerprint = 'z'")
    assert [(r["group"], r["item"], r["fingerprint"], r["contamination_score"]) for r in compare.fingerprint_groups(one, two).collect()] == [(1, 1, "y", 0.7), (1, 2, "y", 0.8), (2, 1, "x", 0.9)]
    assert [(r["rank"], r["eval_line"], r["n_matches"], r["files"], r["eval_text"]) for r in review.top_examples(one).collect()] == [(1, 1, 3, "f,g", "t"), (2, 5, 2, "h", "u")]


def test_options_of_a_file_and_reports_with_their_source(spark, tmp_path):
    from sievelight.config import load_options

    (tmp_path / "c.yaml").write_text("ngram_size: 7\ntokenizer_str: uniseg\nperfect_match_decay_end: null\nsomething_else: 3\n")
    found = load_options(str(tmp_path / "c.yaml"), sample_every_m_tokens=4, purify=None)
    assert (found.ngram_size, found.tokenizer, found.perfect_match_decay_end, found.sample_every_m_tokens, found.purify) == (7, "uniseg", None, 4, False)
    with pytest.raises(ValueError):
        load_options(str(tmp_path / "c.yaml"), ngram_size=0)
    (tmp_path / "r" / "deep").mkdir(parents=True)
    (tmp_path / "r" / "deep" / "x.jsonl").write_text('{"training_file": "f", "training_line": 3}\nbroken\n{"training_file": "g", "training_line": 4, "unknown": 1}\n')
    rows = jsonl.read_reports(spark, str(tmp_path / "r"), with_source=True).collect()
    assert sorted((r["training_file"], r["training_line"], r["report_file"].rpartition("/")[2]) for r in rows) == [("f", 3, "x.jsonl"), ("g", 4, "x.jsonl")]


def test_an_index_gives_its_memory_back(spark):
    index = index_of(spark, OTHERS)
    index.stats.count()
    index.release()
    assert not any(df.is_cached for df in (index.evals, index.postings, index.stats))


def test_pieces_are_bounded_and_whole():
    sizes = [3, 0, 4, 9, 1, None, 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([None if k is None else ["x"] * k for k in sizes], pa.list_(pa.string()))], ["doc_id", "tokens"])
    parts = [p.column(0).to_pylist() for p in matching.pieces(batch, 1, 7)]
    assert parts == [[0, 1, 2], [3], [4, 5, 6]] and list(matching.bounds([], 7)) == []
    texts = pa.array(["ab cd", None, "", "é"] * 100_000)
    cut = list(tokenizers._lists(texts, pa.int64(), lambda t: list(t.encode())))
    assert len(cut) > 1 and max(len(c.flatten()) for c in cut) <= matching.PIECE
    assert pa.concat_arrays(cut).to_pylist() == [list((t or "").encode()) for t in texts.to_pylist()]


def test_tokens_of_many_pieces_stay_with_their_rows(spark):
    rows = spark.range(0, 6_000, 1, 1).withColumn("t", F.when(F.col("id") % 7 != 0, F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 60)))
    for name in ("uniseg", "bytes", "r50k"):
        sizes = rows.select("id", F.size(tokenizers.tokenize(F.col("t"), name)).alias("n"), F.coalesce(F.length("t"), F.lit(0)).alias("chars"))
        assert sizes.where("(n = 0) <> (id % 7 = 0)").count() == 0
        assert name != "bytes" or sizes.where("n <> chars").count() == 0


def test_documents_are_searched_once(spark):
    first, second = (index_of(spark, rows) for rows in ([("a", 1, None, QUESTION, ANSWER, PASSAGE), *OTHERS], [("b", 1, None, " ".join(WORDS[200:230]), None, None), *OTHERS]))
    texts = [f"{PASSAGE} so {QUESTION} then {ANSWER} end", f"x {' '.join(WORDS[200:230])} y", "no words of any item are in this text here", "short"]
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = docs_of(spark, *texts)
    counted = docs.mapInArrow(passed, docs.schema)
    assert {r["doc_id"] for r in plan.detect(counted, first).collect()} == {0} and seen.value == 4
    found = plan.search(counted, first, second)
    assert [{r["doc_id"] for r in plan.detect(counted, x, found=found).collect()} for x in (first, second)] == [{0}, {1}] and seen.value == 8


def test_document_frequencies_by_key(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(9, 40))) for _ in range(150)] + ["one two three four five six seven eight nine ten"] * 3
    options = Options()

    def frequencies(docs, limit=20):
        tokens = clusters.training_tokens(docs, options)
        return [tuple(r) for r in counts.hot_ngrams(docs, tokens, 5, limit).collect()], {r["bucket"]: r["n_ngrams"] for r in counts.df_histogram(docs, tokens, 5).collect()}

    def wanted(rows, limit=20):
        df = {}
        for i, t in rows:
            words = t.split()
            for g in {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 10 else ():
                df.setdefault(g, set()).update([i] if i is not None else [])
        top = sorted(((g, len(d)) for g, d in df.items()), key=lambda x: (-x[1], x[0]))[:limit]
        label = lambda k: "1" if k == 1 else "2-10" if k <= 10 else "11-100" if k <= 100 else "101-1000"
        return top, {b: sum(label(len(d)) == b for d in df.values()) for b in {label(len(d)) for d in df.values()}}

    once = list(enumerate(texts))
    # ids that several rows have are one document, and rows without an id are none
    for rows in (once, [(i // 2, t) for i, t in once], [(None if i % 3 == 0 else i, t) for i, t in once], []):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert frequencies(docs) == wanted(rows)
    docs = spark.createDataFrame(once, "doc_id long, text string")
    assert frequencies(docs, 1_000) == wanted(once, 1_000)
    tokens = clusters.training_tokens(docs, options)
    assert "posexplode" not in counts.df_histogram(docs, tokens, 5)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(counts, "MOST_NAMED", 0)
    assert frequencies(docs) == wanted(once)
    assert [len(x) for x in counts.keys_of(pa.array([[], None, ["a"]], pa.list_(pa.string())), 5)] == [0] * 4 and [len(x) for x in counts.keys_of(pa.array([], pa.list_(pa.string())), 5)] == [0] * 4


def test_shared_passages_make_no_square_of_hits(spark, monkeypatch):
    from sievelight.operators import index as module

    rng = random.Random(9)
    shared = [f"s{i}" for i in range(25)]
    own = [[f"o{k}x{rng.randrange(10**6)}" for _ in range(30)] for k in range(40)]
    # items of every share of their own words, some with few; some texts are whole, some cut
    items = [" ".join([*w[: 3 + k % 28], *shared]) for k, w in enumerate(own)]
    rows = [("a", k, None, t, None, None) for k, t in enumerate(items)]
    docs = docs_of(spark, *[f"x {t} y" for t in items], *[f"x {' '.join(t.split()[4:])} y z u v w" for t in items])
    kept = ("doc_id", "eval_id", "start", "end", "ngram_match_cnt")
    found = lambda index: sorted((*(r[c] for c in kept), round(r["contamination_score"], 9)) for r in plan.detect(docs, index).collect())
    hits = lambda df: sorted((r["doc_id"], r["eval_id"], r["pos"], r["ngram"], round(r["idf"], 9)) for r in df.collect())
    small = index_of(spark, rows)
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    large = index_of(spark, rows)
    tokens = clusters.training_tokens(docs, LAX)
    every = hits(clusters.probe(tokens, large))
    assert found(small) == found(large) and len(found(large)) >= 40 and every == hits(clusters.probe(tokens, small))
    needed = hits(clusters.needed_hits(tokens, large, plan.needed_share(LAX)))
    assert set(needed) <= set(every) and len(needed) < len(every) / 4
    none = Options(eval_min_token_length=0, eval_min_unique_word_count=0, contamination_score_threshold=0.0, perfect_match_decay_start=None, perfect_match_decay_end=None)
    assert hits(clusters.needed_hits(tokens, large, plan.needed_share(none))) == every


def test_an_index_shuffles_its_postings_once(spark):
    raw = spark.createDataFrame([(i, f"{' '.join(WORDS[i : i + 30])} x") for i in range(0, 60, 3)], "eval_id long, question string")
    postings = build_index(raw, LAX).postings
    assert "Join" not in postings._jdf.queryExecution().analyzed().toString()
    df = {}
    for r in postings.collect():
        df.setdefault(r["ngram"], []).append(r["df"])
    assert all(set(v) == {len(v)} for v in df.values()) and max(map(len, df.values())) > 1
