"""Every operator against a brute-force version on small tables, and its edge cases."""

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, label int"
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def docs_of(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [((ids[i] if ids else i), t, "en", (sources[i] if sources else "s"), len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("aa bb cc dd ee ff gg hh ii jj kk ll mm nn oo pp".split()) + str(rng.randrange(60)) for _ in range(n))


ODD = [None, "", " \n\t", "One", "é ü ß", "a" * 3_000, "same text here", "same text here"]


# --- 1


def test_decontaminate(spark):
    from sievelight.llm.decontaminate import decontaminate, scan_benchmark

    item = prose(40, 1)
    items = spark.createDataFrame([(1, item), (2, "Short Item"), (3, None), (4, ""), (None, "only null"), (1, item)], "item_id long, text string")
    docs = docs_of(spark, [*ODD, prose(500, 2) + " " + " ".join(item.split()[3:20]).upper() + " end", "x short, item! y", "only null z", item + " " + prose(5, 3)])
    for size in (1, 2_000_000):  # one block for each item, and one for all
        got = {r["doc_id"]: r for r in scan_benchmark(docs, items, block_bytes=size).collect()}
        assert len(got) == 12 and [got[i]["n_words"] for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 3]
        assert (got[8]["n_hit"], got[8]["n_items"], got[8]["contaminated"]) == (17, 1, False)
        assert got[8]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and got[0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
        assert (got[9]["n_hit"], got[9]["contaminated"]) == (2, True) and (got[10]["n_hit"], got[10]["n_items"]) == (2, 0)
    left = {r["doc_id"]: r for r in decontaminate(docs, items).collect()}
    assert set(left) == {*range(8), 8} and left[8]["text"].endswith("end") and " ".join(item.split()[3:20]).upper() not in left[8]["text"] and left[8]["label"] == 1
    assert scan_benchmark(docs.limit(0), items).count() == 0 and scan_benchmark(docs, items.limit(0)).where("n_hit > 0").count() == 0


# --- 2


def test_warc_revisits(spark):
    from sievelight.llm.warc import dedup_archives

    html = ["<p>é\r\n\r\nWARC/1.0</p>", None, "", "<p>one</p>", "<p>é\r\n\r\nWARC/1.0</p>", "<p>one</p>"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, 9) for i, h in enumerate(html)], "page_id long, url string, html string, payload_bytes int")
    import base64

    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    got = {r["page_id"]: tuple(r)[1:] for r in dedup_archives(pages).collect()}
    first = {}
    for i, h in enumerate(html):
        at = first.setdefault(h or "", i)
        assert got[i] == (len((h or "").encode()), digest(h), "response" if at == i else "revisit", None if at == i else at)
    assert {r["record_type"] for r in dedup_archives(pages, least=100).collect()} == {"response"}
    assert dedup_archives(pages.limit(0)).count() == 0


# --- 3


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    where = {}
    for k, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            where.setdefault(b[p : p + length], []).append((k, p))
    out = [bytearray(len(b)) for b in raw]
    for places in where.values():
        if len(places) > 1:
            for k, p in places:
                out[k][p : p + length] = b"\1" * length
    return [(len(b), sum(m), len([x for x in bytes(m).split(b"\0") if x]), hashlib.sha256(bytes(c for c, f in zip(b, m, strict=True) if not f)).hexdigest()) for b, m in zip(raw, out, strict=True)]


@pytest.mark.parametrize("group_rows", [1, 20_000])
def test_suffix_dedup(spark, group_rows):
    from sievelight.llm.suffixes import cut_repeats

    base = prose(120, 5)
    texts = [*ODD, base, "left " + base[50:400] + " right", base[:200] + "!" + base[200:], "ab" * 60, base[100:180] + base[100:180], *[prose(6, s) + base[60:140] + prose(6, s + 50) for s in range(20, 30)]]
    got = sorted((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in cut_repeats(docs_of(spark, texts), length=40, gram=20, group_rows=group_rows).collect())
    assert [x for _, x in got] == brute_repeats(texts, 40)
    assert cut_repeats(docs_of(spark, ["x"]).limit(0), length=40, gram=20).count() == 0


def test_hash_compared_mergesort():
    import numpy as np

    from sievelight.llm.bytewords import BYTE_CODE, powers
    from sievelight.llm.suffixes import Suffixes

    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (70, 30), dtype=np.uint8)
    reach, group = rng.integers(0, 11, 70), rng.integers(0, 3, 70)
    sums = np.zeros((70, 31), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[rows] * powers(30)[0][:30], axis=1, out=sums[:, 1:])
    for way in (1, -1):
        suffix = lambda i: (group[i], bytes(rows[i, 20 : 20 + reach[i]] if way > 0 else rows[i, 20 - reach[i] : 20][::-1]))  # noqa: E731, B023
        order = Suffixes(group, rows, sums, reach, 20, way).sort()
        assert [suffix(i) for i in order] == sorted(map(suffix, range(70)))


# --- 4


def test_media_digests(spark):
    import zlib

    from sievelight.llm.media import media_digests

    got = {r["doc_id"]: r for r in media_digests(docs_of(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert tuple(got[i])[1:5] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tuple(got[6])[1:] == tuple(got[7])[1:]
    assert media_digests(docs_of(spark, ["x"]).limit(0)).count() == 0


# --- 5


def test_near_passages(spark):
    from sievelight.llm.passages import near_passages

    shared, near = prose(80, 1), prose(80, 2)
    edited = near.split()
    edited[40] = "changed"
    texts = [prose(200, 10) + " " + shared + " " + prose(50, 11), prose(90, 12) + " " + shared.upper() + " " + prose(20, 13), prose(30, 14) + " " + near, " ".join(edited) + " " + prose(150, 15), prose(300, 16), *ODD, prose(70, 17), prose(70, 17), shared[:200]]
    got = [tuple(r) for r in near_passages(docs_of(spark, texts)).collect()]
    assert {(a, b) for a, b, *_ in got} == {(1, 0), (3, 2), (14, 13)}
    _, _, start, n, first, exact = next(x for x in got if x[0] == 1)
    assert start <= 90 and start + n >= 170 and abs(start - 90 - (first - 200)) <= 16 and not exact
    assert near_passages(docs_of(spark, ["x"]).limit(0)).count() == 0


def brute_passages(texts, size=5, words=50, percent=80):
    """Documents of which a passage has the similarity to one of an earlier document."""
    span, out = words - size + 1, set()
    lists = [[tuple(w[i : i + size]) for i in range(len(w) - size + 1)] for w in (t.lower().split() for t in texts)]
    for x, mine in enumerate(lists):
        for y, other in enumerate(lists[:x]):
            if set(mine) & set(other):
                sets = [set(other[j : j + span]) for j in range(len(other) - span + 1)]
                passages = (set(mine[i : i + span]) for i in range(len(mine) - span + 1))
                if any(100 * len(p & q) >= percent * len(p | q) for p in passages for q in sets):
                    out.add((x, y))
    return out


def edit(text, places):
    words = text.split()
    for at in places:
        words[at] = f"edited{at}"
    return " ".join(words)


def test_near_passages_after_earlier_variants(spark):
    from sievelight.llm.passages import near_passages

    texts = []
    for k in range(12):
        passage = prose(50, 100 + k)
        variants = [edit(passage, places) for places in ((10, 30), (20, 40), (15, 33), (25, 44))]  # of each other and of the passage under 0.8
        texts += [f"{prose(20, 1000 + 10 * k + i)} {v} {prose(20, 2000 + 10 * k + i)}" for i, v in enumerate([*variants, passage, passage, edit(passage, [25])])]
    truth = brute_passages(texts)
    assert {x % 7 for x, _ in truth} == {5, 6}
    got = {(r["doc_id"], r["first_doc_id"]) for r in near_passages(docs_of(spark, texts)).collect()}
    assert got <= truth and {x for x, _ in got} == {x for x, _ in truth}


def test_passages_are_verified_over_their_union_and_found_within_a_text(spark):
    from sievelight.llm.passages import near_passages

    often = "w " * 60
    rarely = " ".join(f"{prose(20, 300 + i)} w" for i in range(5)) + " " + prose(20, 309)
    shared = prose(60, 310)
    twice = f"{prose(30, 311)} {shared} {prose(40, 312)} {shared} {prose(30, 313)}"
    rows = [tuple(r) for r in near_passages(docs_of(spark, [rarely, often, twice])).collect()]
    assert {(a, b) for a, b, *_ in rows} <= {(1, 1), (2, 2)}  # a word said again is near itself, but not near other words
    found = [r for r in rows if r[0] == 2]
    assert found and min(r[2] for r in found) >= 130 - 16 and all(abs(r[2] - r[4] - 100) <= 1 for r in found)


@pytest.mark.parametrize("kind", ["changed", "put in", "left out"])
@pytest.mark.parametrize("place", [3, 20, 47])
def test_a_passage_with_one_edit_is_found_from_every_seed(kind, place):
    import numpy as np

    from sievelight.llm import passages

    edited = prose(50, 1).split()
    edited[place : place + (kind != "put in")] = [] if kind == "left out" else ["zz"]
    x, y = passages.shingles_of([f"{prose(30, 5)} {prose(50, 1)} {prose(30, 6)}", f"{prose(10, 7)} {' '.join(edited)} end of it {prose(30, 8)}"], 5)
    at = {k: i for i, k in enumerate(y.tolist())}
    for i, k in enumerate(x.tolist()):
        if k in at:
            seed = np.array([[0, max(0, i - 60), i, i + 60, max(0, at[k] - 60), at[k], at[k] + 60]])
            assert passages.verified_passages(x, y, seed, 46, 80, 1, False)
            assert not passages.verified_passages(x, y, seed, 46, 80, 2, False)


def test_links_join_what_all_pairs_join(spark):
    from sievelight.llm.passages import near_components, near_passages

    texts = []
    for k in range(4):  # the last of each three is near both others, and they are below 0.8 of each other
        passage = prose(50, 700 + k)
        texts += [f"{prose(20, 800 + 10 * k + i)} {v} {prose(20, 900 + 10 * k + i)}" for i, v in enumerate([edit(passage, [10]), edit(passage, [35]), passage])]
    texts += [prose(120, 990), None, "w " * 30, "w " * 30]
    truth = brute_passages([t or "" for t in texts])
    links = {(r["doc_id"], r["first_doc_id"]) for r in near_passages(docs_of(spark, texts)).collect()}
    assert truth == {(3 * k + 2, 3 * k + i) for k in range(4) for i in (0, 1)} and links == truth
    rows = {r["doc_id"]: (r["component_id"], r["repeats"]) for r in near_components(docs_of(spark, texts)).collect()}
    assert rows == {i: (3 * (i // 3), True) if i < 12 else (i, False) for i in range(16)}


def test_alignments_against_sets_of_all_passages():
    import numpy as np

    from sievelight.llm.passages import best_alignments, passage_sizes

    rng = np.random.default_rng(2)
    for k in range(60):
        span, percent, s = int(rng.integers(2, 9)), int(rng.choice([50, 80, 90])), int(rng.integers(-5, 6))
        x, y = (rng.integers(0, 3 + k // 2, int(rng.integers(span, 40))).astype(np.uint64) for _ in range(2))
        y[: len(x) // 2] = x[: len(x) // 2][: len(y)]
        mine, other = ([set(z[i : i + span].tolist()) for i in range(len(z) - span + 1)] for z in (x, y))
        assert passage_sizes(x, span)[1].tolist() == [len(p) for p in mine]
        (before, sizes), (other_before, other_sizes) = passage_sizes(x, span), passage_sizes(y, span)
        hit, shift = best_alignments(x, y, np.arange(len(mine)), s, span, percent, False, before, other_before, sizes, other_sizes)
        near = {i: [abs(i - j - s) for j, q in enumerate(other) if abs(i - j - s) < span and 100 * len(p & q) >= percent * len(p | q)] for i, p in enumerate(mine)}
        assert {i: abs(d - s) for i, d in zip(hit.tolist(), shift.tolist(), strict=True)} == {i: min(d) for i, d in near.items() if d}


def test_near_passages_share_a_seed():
    import numpy as np

    from sievelight.llm.passages import near_runs, seed_places, seed_runs

    rng = np.random.default_rng(3)
    base = np.concatenate([rng.integers(0, 1 << 62, 150), np.resize(rng.integers(0, 1 << 62, 5), 60)])

    def text():
        kinds = [lambda: rng.integers(0, 1 << 62, rng.integers(10, 80)), lambda: np.resize(rng.integers(0, 1 << 62, rng.integers(1, 12)), rng.integers(20, 160)), lambda: base[(a := rng.integers(0, 100)) : a + rng.integers(30, 90)]]
        return np.concatenate([np.zeros(0, np.int64), *[kinds[rng.integers(0, 3)]() for _ in range(4)]]).astype(np.uint64)

    seen = set()
    for k in range(80):
        x, y = text(), text()
        if k % 2:
            y = x.copy()
            changed = rng.random(len(y)) < 0.1
            y[changed] = rng.integers(0, 1 << 62, changed.sum()).astype(np.uint64)
        mine, other = ({frozenset(z[i : i + 46].tolist()) for i in range(len(z) - 45)} for z in (x, y))
        near = any(100 * len(p & q) >= 80 * len(p | q) for p in mine for q in other)
        places = [seed_places(z, np.ones(len(z), bool), 46, 80)[0] for z in (x, y)]
        p, q = np.nonzero(x[places[0], None] == y[places[1]])
        found = near_runs(x, y, seed_runs(places[0][p], places[1][q], 46), 46, 80, False) if len(p) else []
        assert bool(found) == near
        seen.add(near)
    assert seen == {False, True}


def test_seeds_are_counted_once_for_a_passage(spark):
    import numpy as np

    from sievelight.llm import passages

    # texts of repeated words that have one run in common: one shingle of 16, at nine places
    texts = ["the " * 13 + " ".join(f"w{i}x{k} " * 13 for k in range(3)) for i in range(70)]
    rows = docs_of(spark, texts).selectExpr("doc_id AS row", "doc_id", "text")
    kept = lambda df: passages.shared_seeds(passages.find_seeds(df, size=5, span=46, percent=80), span=46, percent=80).count()
    assert kept(rows) == 0 and kept(docs_of(spark, [texts[0], texts[0] + " end"]).selectExpr("doc_id AS row", "doc_id", "text")) > 0
    rng = np.random.default_rng(4)
    for _ in range(50):
        span, text, place, reach, most = int(rng.integers(1, 20)), [], [], [], []
        for t in range(3):
            before, _ = passages.passage_sizes(rng.integers(0, rng.integers(1, 40), rng.integers(1, 150)).astype(np.uint64), span)
            own = np.flatnonzero(rng.random(len(before)) < 0.5)
            text, place, reach = text + [t] * len(own), place + own.tolist(), reach + (own - before[own]).tolist()
            most += [max(int(((before[own] < s) & (own >= s)).sum()) for s in range(before[p] + 1, p + 1)) for p in own]
        assert passages.most_held(*(np.array(z, np.int64) for z in (text, place, reach)), span).tolist() == most


def test_a_later_link_takes_whole_components_along(spark):
    from sievelight.llm.passages import joined_components
    from sievelight.llm.scratch import Scratch

    labels = spark.createDataFrame([(k, k) for k in range(12)], "cid long, label long")
    for found in ([(10, 9), (9, 11), (8, 7)], [(10, 5), (8, 11), (3, 3)], [(7, 2)]):
        labels = joined_components(labels, spark.createDataFrame(found, "x long, y long"), Scratch(spark, "joined"))
    assert {r["cid"]: r["label"] for r in labels.collect()} == {k: 2 if k in (2, 5, 7, 8, 9, 10, 11) else k for k in range(12)}


# --- 6


def brute_components(texts, size, percent):
    from sievelight.llm.setsketch import shingle_set

    sets, least = [shingle_set(t, size) for t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= percent * len(a | b) and least[i] != least[j]:
                    low = min(least[i], least[j])
                    least[i] = least[j] = low
                    changed = True
    return [(len(s), c) for s, c in zip(sets, least, strict=True)]


def test_near_duplicates(spark):
    from sievelight.llm.setsketch import near_duplicates

    base = prose(100, 1).split()
    texts = [*ODD, "One", "one", "a b", "b a"]
    for k in range(40):  # a chain and a crowd around one text, near the threshold
        rng = random.Random(k)
        words = base[:]
        for _ in range(k // 3):
            words[rng.randrange(100)] = f"z{rng.randrange(1000)}"
        texts.append(" ".join(words))
    got = sorted((r["doc_id"], (r["n_shingles"], r["component_id"]), r["kept"]) for r in near_duplicates(docs_of(spark, texts), size=2).collect())
    assert [x for _, x, _ in got] == brute_components(texts, 2, 80)
    assert all(kept == (i == c) for i, (_, c), kept in got)
    twice = near_duplicates(docs_of(spark, ["p q r", "p q r", "p q r", None], ids=[None, 5, 5, None]), size=2).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in twice) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_estimates_are_near_the_similarity():
    import numpy as np

    from sievelight.llm import setsketch as s

    rng = np.random.default_rng(2)
    for shared in (0.5, 0.8, 0.9):
        errors = []
        for _ in range(30):
            x = rng.integers(0, 1 << 63, 1_000, dtype=np.uint64)
            n = int(1_000 * 2 * shared / (1 + shared))
            y = np.concatenate([x[:n], rng.integers(0, 1 << 63, 1_000 - n, dtype=np.uint64)])
            buffer = np.empty((512, s.REGISTERS), np.uint32)
            a, b = (s.registers(s.least_hashes(z, buffer))[None, :] for z in (x, y))
            errors.append(s.estimate(a, b, np.array([1000.0]), np.array([1000.0]))[0] - n / (2_000 - n))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    merged = s.registers(s.least_hashes(np.concatenate([x, y]), buffer))
    assert np.array_equal(merged, np.maximum(a[0], b[0]))


# --- 7


def test_chat_parts_and_round_trip(spark):
    from sievelight.llm.chat import PART, format_chat, read_chat

    rows = [
        (1, 1, "assistant", [("text", "~0 ~1<|end|>\n[INST]", None, None)]),
        (1, 0, "user\n<|turn|>", [("text", "see ", None, None), ("image", None, "i.png", 2), ("text", None, None, None), ("audio", "x", "a.wav", 3), ("document", None, None, None), ("other", "t", "r", 1)]),
        (2, 0, None, []),
        (2, None, "assistant", [("text", "first", None, None)]),
        (None, 0, "assistant", [("text", "é", None, None)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")
    got = {r["conv_id"]: r for r in read_chat(format_chat(turns)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user\n<|turn|>", "see <|image|><|audio|><|document|>t"), ("assistant", "~0 ~1<|end|>\n[INST]")]
    assert [tuple(a) for a in got[1]["attachments"]] == [("image", "i.png", 512), ("audio", "a.wav", 75), ("document", None, 512)]
    assert got[1]["loss_text"] == "~0 ~1<|end|>\n[INST]" and got[2]["loss_text"] == "first" and got[None]["loss_text"] == "é"
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "first"), ("", "")]
    assert format_chat(turns.limit(0)).count() == 0


# --- 8


def test_quality(spark):
    from sievelight.llm.quality import keep_good, score_quality, train_quality

    texts = [prose(40, i) + (" awfulword" if i % 4 == 0 else " $$$ !!! $$$ ### &&& ***" * 12 if i % 4 == 1 else "") for i in range(400)]
    docs = docs_of(spark, [*texts, None, "", "x"])
    labels = spark.createDataFrame([(i, 0 if i % 4 == 1 else 1, int(i % 4 == 0)) for i in range(300)] + [(0, None, 1), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_quality(docs, train_quality(docs, labels)).collect()}
    assert len(got) == 403
    right = [got[i]["kept"] == (i % 4 > 1) for i in range(300, 400)]
    assert sum(right) >= 95
    assert sum(got[i]["p_acceptable"] < 0.5 for i in range(300, 400, 4)) >= 20
    assert all(0 <= r["p_good"] <= r["p_acceptable"] <= 1 for r in got.values())
    assert keep_good(docs, labels).columns == docs.columns
    assert keep_good(docs, labels.limit(0)).count() == 403 and keep_good(docs.limit(0), labels).count() == 0


# --- 9


def brute_lines(texts, least):
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n") if t is not None else []
        gone = set()
        for i in range(len(lines) - least + 1):
            key = tuple(lines[i : i + least])
            if key in seen:
                gone.update(range(i, i + least))
            seen.add(key)
        out.append(None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_dedup(spark, least):
    from sievelight.llm.linededup import dedup_lines

    rng = random.Random(least)
    texts = [*ODD, "a\na\na\na\na\na\na", "x\n\n\ny", *["\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(30)]]
    got = sorted((r["doc_id"], r["text"]) for r in dedup_lines(docs_of(spark, texts), min_lines=least).collect())
    assert [t for _, t in got] == brute_lines(texts, least)
    assert dedup_lines(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_line_dedup_by_words(spark):
    import corpus_pipeline

    one, half, rest = prose(50, 31), prose(25, 32), prose(26, 33)
    texts = [f"{one}\na\n{half}\n{rest}", f"b\n{one}\nc\n{half}\nd", f"e\n{half}\n{rest}\nf\n{rest}", f"{one}\n{one}\n{prose(49, 34)}", prose(49, 34) + "\ng", one]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs_of(spark, texts), "").collect()}
    assert got == {0: texts[0], 1: f"b\nc\n{half}\nd", 2: f"e\nf\n{rest}", 3: prose(49, 34), 4: texts[4]}


# --- 10


def test_source_targets():
    from sievelight.llm.mixing import source_targets

    assert source_targets([100, 100, 100], [1, 2, 3], 3) == pytest.approx([50, 100, 150])
    assert source_targets([10, 1000, 10], [1, 1, 8], 3) == pytest.approx([30, 960, 30])
    assert source_targets([0, 5], [5, 1], 3) == pytest.approx([0, 5]) and source_targets([], [], 3) == []


def test_permutations_and_draws():
    import numpy as np

    from sievelight.llm.mixing import permuted, residual_draws

    for n in (1, 2, 3, 17, 1000):
        assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))) == list(range(n))
    expected, most = np.array([100.25, 0.0, 3000.0, 7.5, 0.75]), np.array([300, 0, 3000, 8, 2])
    drawn = np.stack([residual_draws(expected, most, np.random.default_rng(i)) for i in range(2_000)])
    assert (drawn >= np.floor(expected)).all() and (drawn <= most).all() and (drawn[:, [1, 2]] == [0, 3000]).all()
    assert np.ptp(drawn.sum(1)) <= 2 and np.abs(drawn.mean(0) - expected).max() < 0.1


def test_mix(spark):
    from sievelight.llm.mixing import mix_blocks, mix_counts

    texts = [prose(50 + 7 * i, i) for i in range(60)] + [None, "", "same words", "same words"]
    sources = [("b", "a", None)[i % 3] for i in range(60)] + ["b", "c", "b", "b"]
    docs = docs_of(spark, texts, sources=sources)
    rows = mix_counts(docs).collect()
    assert len(rows) == 64 and sorted(map(str, rows)) == sorted(map(str, mix_counts(docs.repartition(7)).collect()))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for source in ("a", "b", None):
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 32
    blocks = mix_blocks(docs).collect()
    assert sum(len(r["text"].split()) for r in blocks) == sum(r["taken"] for r in rows)
    assert mix_counts(docs.limit(0)).count() == 0


def test_mix_counts_what_was_written(spark):
    from sievelight.llm.mixing import mix_blocks, mix_counts
    from sievelight.llm.scratch import Scratch

    docs = docs_of(spark, [prose(40 + i, i) for i in range(20)], sources=["a", "b"] * 10)
    scratch = Scratch(spark, "mixed")
    rows = mix_counts(docs, scratch=scratch).collect()
    written = spark.read.parquet(f"{scratch.root}/*-mix").select("shard", "slot", "source", "epoch", "block", "text")
    assert sorted(written.collect()) == sorted(mix_blocks(docs).collect())
    assert sum(len(r["text"].split()) for r in written.collect()) == sum(r["taken"] for r in rows) > 0


# --- the pipeline


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    item = prose(60, 99)
    good = [prose(120, i) for i in range(30)]
    lines = "\n".join(prose(20, 500 + i) for i in range(6))
    texts = [*good, good[3], good[4] + " tail", item, good[5] + "\n" + lines, prose(90, 300) + "\n" + lines, None, ""]
    docs_of(spark, texts).drop("words", "label").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(30)) - {5} <= got and not {30, 31, 32} & got and 34 in got
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where(F.col("doc_id") == 34).first()["n_chars"] < len(texts[34])
