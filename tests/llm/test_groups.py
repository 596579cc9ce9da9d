"""Large groups, forced hash collisions, and scores against naive versions."""

import random

import numpy as np
import pytest

from tests.llm.test_operators import brute_components, docs_of, prose


@pytest.mark.parametrize("rounds", [0, 2])
def test_one_bucket_of_many_blocks(spark, monkeypatch, rounds):
    from sievelight.llm import setsketch

    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 8)
    monkeypatch.setattr(setsketch, "HUB_ROUNDS", rounds)
    base, texts = prose(120, 1).split(), []
    for k in range(90):  # most are linked to some others, and many to none, with similarities around the threshold
        rng, words = random.Random(k), base[:]
        for _ in range(rng.randrange(2, 11)):
            words[rng.randrange(120)] = f"z{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    got = sorted((r["doc_id"], (r["n_shingles"], r["component_id"])) for r in setsketch.near_duplicates(docs_of(spark, texts), size=2).collect())
    wanted = brute_components(texts, 2, 80)
    assert [x for _, x in got] == wanted and 5 < len({c for _, c in wanted}) < 85


def test_a_block_returns_one_link_for_each_joining():
    from sievelight.llm import setsketch as s

    def members(sets, labels, big):
        out = object.__new__(s.Members)
        n = len(sets)
        out.cid, out.label, out.big = np.arange(n), np.array(labels), np.full(n, big)
        out.size, out.band, out.regs = np.array([len(x) for x in sets]), np.zeros(n, np.int8), np.zeros((n, s.REGISTERS), np.int16)
        out.shingles, out.owner = np.concatenate([np.array(sorted(x), np.uint64) for x in sets]), np.repeat(np.arange(n), [len(x) for x in sets])
        return out

    sets = [set(range(10)), set(range(10)) | {50}, set(range(11)), set(range(100, 110)), set(range(100, 109)) | {7}]
    x = members(sets, [0, 1, 2, 3, 4], 0)
    assert s.common_shingles(x, x).tolist() == [[len(a & b) for b in sets] for a in sets]
    links = s.joining_links(x, x, 80, {})
    assert len(links) == 3 and {frozenset(a) for a in links} <= {frozenset(a) for a in ((0, 1), (0, 2), (1, 2), (3, 4))}


def test_unequal_strings_of_equal_hashes_stay(monkeypatch):
    from sievelight.llm import suffixes

    codes = suffixes.BYTE_CODE.copy()
    codes[ord("b")] = codes[ord("a")]  # now these two bytes have the same hashes everywhere
    monkeypatch.setattr(suffixes, "BYTE_CODE", codes)
    rows = np.array([list(b"xxaayyyy"), list(b"xxbbyyyy"), list(b"zzaayyyy"), list(b"zzaayyyy")], np.uint8)
    left, right, zero = np.full(4, 4), np.full(4, 4), np.zeros(4, np.int64)
    # middle 4, strings of 4 bytes: of offsets 0 to 4
    least, most = suffixes.covered(zero, rows, left, right, 4, zero, zero + 4)
    assert (least[2], most[2], least[3], most[3]) == (0, 4, 0, 4)
    assert most[1] <= 0 and most[0] <= 2  # "bb" is not "aa"


@pytest.mark.parametrize("rows", [3, 10_000])
def test_groups_that_fall_apart_by_halves(spark, rows):
    from sievelight.llm.suffixes import cut_repeats
    from tests.llm.test_operators import brute_repeats

    line = prose(12, 1)  # in many contexts
    texts = [f"{prose(8, 100 + i)} {line} {prose(8, 200 + i)}" for i in range(40)] + [f"{prose(3, 300 + i % 4)} {line} {prose(9, 400 + i % 3)}" for i in range(24)]
    got = sorted((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in cut_repeats(docs_of(spark, texts), length=60, gram=30, group_rows=rows).collect())
    assert [x for _, x in got] == brute_repeats(texts, 60)


def test_scores_are_sums_of_the_weights_of_a_texts_features():
    from sievelight.llm import quality

    texts = [prose(40, i) + "!" * i for i in range(12)] + ["", "é ü", "x"]
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    model = quality.Ordinal(np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32), np.array([-1.0, 0.5]))
    batch = model.score(data, ends)
    for i, r in enumerate(raw):
        row, code = quality.features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert not row.any() and abs(sum(float(model.weights[c]) for c in code.tolist()) - batch[i]) < 1e-3
    tails = model.tails(batch)
    assert (tails[:, 0] >= tails[:, 1]).all() and np.allclose(tails[:, 1], 1 / (1 + np.exp(0.5 - batch)))


def test_targets_against_water_poured_drop_by_drop():
    from sievelight.llm.mixing import default_weights, source_targets

    rng = random.Random(4)
    for _ in range(20):
        sizes = [rng.choice([0, 1, 5, 40, 900]) for _ in range(rng.randrange(1, 9))]
        weights, total = default_weights(len(sizes)), sum(sizes)
        low, high = 0.0, 3.0 * total + 1
        for _ in range(100):  # the level at which all is poured
            level = (low + high) / 2
            low, high = (level, high) if sum(min(level * w, 3 * n) for w, n in zip(weights, sizes, strict=True)) < total else (low, level)
        assert source_targets(sizes, weights, 3) == pytest.approx([min(high * w, 3 * n) for w, n in zip(weights, sizes, strict=True)], abs=1e-6)
