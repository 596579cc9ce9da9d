"""Clashing columns, very long texts, repeated ids, ties and empty tables, for every operator and stage."""

import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_lines, brute_repeats, prose

OWN_NAMES = ["row", "r", "n_lines", "n_removed", "n_runs", "kept", "kept_id", "target", "size", "key", "d", "doc", "label", "cid", "rank", "rest", "doc_no", "digest", "component", "fn", "at", "words", "hash"]


def hostile(spark, texts, ids=None):
    """Documents with a column for every name that operators use inside."""
    rows = [((ids[i] if ids else i), t, "en", "s", len(t or ""), *[f"{n}{i}" for n in OWN_NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in OWN_NAMES))


TEXTS = ["a\nb\nc\nd", "a\nb\nc\ne", None, "", prose(60, 1), prose(60, 1), prose(80, 2)]


def runs_of(spark):
    from sievelight.llm import decontaminate, linededup, media, mixing, passages, quality, setsketch, suffixes

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(60, 1))], "item_id long, text string")
    return {
        "scan_benchmark": lambda d: decontaminate.scan_benchmark(d, items), "decontaminate": lambda d: decontaminate.decontaminate(d, items), "cut_repeats": suffixes.cut_repeats, "media_digests": media.media_digests,
        "near_passages": passages.near_passages, "near_duplicates": setsketch.near_duplicates, "keep_one": setsketch.keep_one, "score": lambda d: quality.score_quality(d, quality.train_quality(d, labels)),
        "keep_good": lambda d: quality.keep_good(d, labels), "dedup_lines": linededup.dedup_lines, "without_repeats": linededup.without_repeats, "mix_counts": mixing.mix_counts, "mix_blocks": mixing.mix_blocks,
    }


NAMES = ["scan_benchmark", "decontaminate", "cut_repeats", "media_digests", "near_passages", "near_duplicates", "keep_one", "score", "keep_good", "dedup_lines", "without_repeats", "mix_counts", "mix_blocks"]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(spark, name):
    run = runs_of(spark)[name]
    got = run(hostile(spark, TEXTS))
    plain = run(hostile(spark, TEXTS).select("doc_id", "text", "lang", "source", "n_chars"))
    shared = [c for c in plain.columns if c in got.columns]
    assert len(set(got.columns)) == len(got.columns) and shared == plain.columns
    assert sorted(map(repr, got.select(*shared).collect())) == sorted(map(repr, plain.collect()))
    if name in ("decontaminate", "keep_one", "keep_good", "without_repeats"):
        assert got.columns == hostile(spark, TEXTS).columns and all(r["n_runs"] == f"n_runs{r['doc_id']}" for r in got.collect())


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = hostile(spark, TEXTS)
    spark.createDataFrame([(1, prose(60, 9))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        got = stage(spark, docs, str(tmp_path))
        if name != "mix":
            assert got.columns == docs.columns
        assert 1 <= got.count() <= 7, name
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_stays_of_each_component_whatever_the_ids(spark):
    from sievelight.llm.setsketch import keep_one

    near = prose(100, 5).split()
    near[50] = "edited"
    texts = [prose(100, 5), " ".join(near), prose(100, 5), prose(90, 6), prose(90, 6), None, None, ""]
    ids = [7, 7, 3, 8, 8, 1, 1, None]
    got = keep_one(hostile(spark, texts, ids)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(r["text"] or "")) for r in got) == sorted([(3, len(texts[0])), (8, len(texts[3])), (1, 0), (1, 0), (-1, 0)])
    assert [r["n_runs"] for r in got if r["doc_id"] == 8] == ["n_runs3"]


LONG = "\n".join(prose(12, 10_000 + i) for i in range(20_000))


@pytest.fixture(scope="module")
def long_docs(spark):
    assert len(LONG) > 1_100_000  # longer than the bytes that are handled at once
    texts = [LONG, "x " + LONG[300_000:300_900] + " y", LONG[:2_000] + "!", prose(50, 3)]
    return texts, spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string").cache()


def test_very_long_texts_by_bytes(spark, long_docs):
    from sievelight.llm.media import media_digests
    from sievelight.llm.suffixes import cut_repeats

    texts, docs = long_docs
    got = sorted((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in cut_repeats(docs).collect())
    assert [x for _, x in got] == brute_repeats(texts, 400)
    for r in media_digests(docs).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\0" * (-len(raw) % 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] < r["payload_bytes"] or r["payload_bytes"] < 1_024


def test_very_long_texts_by_words(spark, long_docs):
    from sievelight.llm.decontaminate import scan_benchmark
    from sievelight.llm.linededup import dedup_lines
    from sievelight.llm.mixing import mix_counts
    from sievelight.llm.passages import near_passages
    from sievelight.llm.quality import score_quality, train_quality
    from sievelight.llm.setsketch import near_duplicates

    texts, docs = long_docs
    words = [t.split() for t in texts]
    items = spark.createDataFrame([(9, " ".join(words[0][100_000:100_030]))], "item_id long, text string")
    scanned = {r["doc_id"]: r for r in scan_benchmark(docs, items).collect()}
    assert scanned[0]["n_words"] == len(words[0]) and scanned[0]["n_hit"] == 30 and scanned[3]["n_hit"] == 0
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == dict(enumerate(brute_lines(texts, 3)))
    sets = [len(set(zip(w, w[1:], strict=False))) for w in words]
    assert {r["doc_id"]: r["n_shingles"] for r in near_duplicates(docs, size=2).collect()} == dict(enumerate(sets))
    mixed = {r["doc_id"]: r for r in mix_counts(docs).collect()}
    assert [mixed[i]["size"] for i in range(4)] == [len(w) for w in words] and all(r["taken"] <= 3 * r["size"] for r in mixed.values())
    for source in "ab":
        own = [r for r in mixed.values() if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 64
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(docs, train_quality(docs, labels)).count() == 4
    assert {(r["doc_id"], r["first_doc_id"]) for r in near_passages(docs).collect()} >= {(1, 0), (2, 0)}


def test_mixing_repeated_ids_and_sizes_that_cut_a_pool(spark):
    from sievelight.llm.mixing import mix_blocks, mix_counts

    texts = [prose(40, i) for i in range(30)] + [prose(40, 99)] * 60 + [None, ""]
    ids = [*range(30), *[500] * 60, 1, 1]
    docs = spark.createDataFrame([(i, t, "a" if k < 30 else "b") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, source string")
    for options in ({}, {"shard_slots": 4, "block_words": 8}):
        rows = mix_counts(docs, **options).collect()
        assert len(rows) == 92 and all(r["taken"] <= 3 * r["size"] for r in rows)
        again = [r["taken"] for r in rows if r["doc_id"] == 500]
        assert max(again) - min(again) <= 1
        blocks = mix_blocks(docs, **options).collect()
        assert sum(r["taken"] for r in rows) == sum(len(r["text"].split()) for r in blocks)
        assert len({(r["shard"], r["slot"]) for r in blocks}) == len(blocks)


def test_the_rated_sample_is_bounded_in_rows_and_bytes(spark):
    from sievelight.llm.quality import rated_sample

    docs = spark.createDataFrame([(1, prose(20, i)) for i in range(50)] + [(2, prose(20, 77))] * 50 + [(3, prose(20, 78)), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    count = lambda *bounds: len(rated_sample(docs, labels, *bounds)[0])
    assert count(1_000) == 53 and count(10) <= 10
    assert 1 <= count(1_000, 1_000) <= 25 and len(rated_sample(docs, labels, 1_000)[1]) == 53


def test_warc_takes_null_and_repeated_page_ids(spark):
    from sievelight.llm.warc import dedup_archives

    pages = spark.createDataFrame([(None, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, None, "same"), (4, "v", None)], "page_id long, url string, html string")
    digest = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in dedup_archives(pages).collect())
    assert got == [(0, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 2, 4), (4, "response", None, 0)]
    assert {r["payload_digest"] for r in dedup_archives(pages).where("page_id = 3").collect()} == {digest}


def test_chat_turns_of_one_number_are_in_the_order_of_their_texts(spark):
    from sievelight.llm.chat import format_chat, read_chat, text_parts

    rows = [(1, 0, "assistant", t) for t in ("Aa", "<a", "~", "[x", "b", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    assert read_chat(format_chat(turns)).first()["loss_text"] == "".join(sorted(t or "" for *_, t in rows))
