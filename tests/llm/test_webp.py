import numpy as np
import pytest

from sievelight.llm import webp, webpbatch
from sievelight.llm.media import padded_size, to_image
from tests.llm.webp_writer import write


def picture(colours, height=23, width=37, seed=1):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    index = rng.integers(0, colours, (height, width))
    index[8:14] = index[1:7]  # something to refer back to
    return table[index]


@pytest.mark.parametrize(
    "options",
    [
        {}, {"cache_bits": 5}, {"references": False}, {"region_bits": 3}, {"transforms": ["green"]}, {"transforms": ["predictor"]}, {"transforms": ["cross"]},
        {"transforms": ["predictor", "cross", "green"], "cache_bits": 9, "region_bits": 2},
    ],
)
def test_decoder_reads_what_the_test_writer_wrote(options):
    for colours in (1, 2, 40, 700):
        image = picture(colours)
        assert np.array_equal(webp.decode(write(image, **options)), image)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 11, 16, 17, 200])
def test_palettes(colours):
    image = picture(colours)
    assert np.array_equal(webp.decode(write(image, transforms=["palette"])), image)
    assert np.array_equal(webp.decode(write(image, transforms=["palette", "predictor"], cache_bits=3)), image)


@pytest.mark.parametrize(
    "options",
    [
        {}, {"cache_bits": 5}, {"cache_bits": 10, "transforms": ["predictor"]}, {"references": False}, {"region_bits": 3}, {"transforms": ["green"]},
        {"transforms": ["predictor", "cross", "green"], "cache_bits": 9, "region_bits": 2}, {"transforms": ["palette"]},
    ],
)
def test_decoder_in_step_reads_what_the_test_writer_wrote(options):
    images = [picture(c, h, w, seed) for c in (1, 2, 40, 200) for h, w, seed in ((23, 37, 1), (14, 1, 2), (17, 64, 3))]
    files = [write(x, **options) for x in images]
    assert all(np.array_equal(a, b) for a, b in zip(webpbatch.decode_many(files), images, strict=True))


def coded_as(data):
    """Names of an image's transforms, and whether it has a cache and back-references."""
    head = webpbatch.read_head(webp.chunk_of(data))
    return [f.__name__ for f, _ in head.undo], head.cache_bits


def test_encoder_chooses_by_content_and_both_decoders_agree():
    rng = np.random.default_rng(3)
    prose = lambda n, seed: to_image(np.frombuffer("".join(np.random.default_rng(seed).choice(list("etaoin shrdlu ,.cmfwyp"), n)).encode(), np.uint8))
    words = [bytes(rng.integers(97, 123, 4, dtype=np.uint8)) for _ in range(150)]
    images = {
        "noise": rng.integers(0, 256, (40, 16, 4), dtype=np.uint8),
        "prose": prose(64 * 50, 1),
        "long prose": prose(64 * 200, 2),
        "short": prose(64, 3),
        "zeros": np.zeros((1, 16, 4), np.uint8),
        "grey": np.repeat(rng.integers(0, 256, (60, 16, 1), dtype=np.uint8), 4, 2),
        "ramp": (np.arange(64 * 60 * 4) // 16 % 256).astype(np.uint8).reshape(60 * 4, 16, 4),
        "columns": np.repeat(rng.integers(0, 256, (1, 16, 4), dtype=np.uint8), 90, 0) + rng.integers(0, 2, (90, 16, 4), dtype=np.uint8),
        "few": rng.integers(0, 256, (7, 4), dtype=np.uint8)[rng.integers(0, 7, (50, 16))],
        "repeated": np.tile(prose(64 * 10, 4), (6, 1, 1)),
        "cached": to_image(np.frombuffer(b"".join(words[i] for i in rng.integers(0, 150, 16 * 60)), np.uint8)),
    }
    files = dict(zip(images, webpbatch.encode_many([*images.values()]), strict=True))
    for name, decoded in zip(files, webpbatch.decode_many([*files.values()]), strict=True):
        assert np.array_equal(decoded, images[name]) and np.array_equal(webp.decode(files[name]), images[name]), name
        assert webpbatch.encode_many([images[name]]) == [files[name]], name  # whatever else is in the batch
    size = {name: len(data) / images[name].size for name, data in files.items()}
    assert coded_as(files["prose"]) == ([], 0) and size["prose"] < 0.8 and size["long prose"] < 0.7
    assert coded_as(files["grey"])[0] == ["uncross"] and size["grey"] < 0.7
    assert coded_as(files["few"])[0] == ["unindex"] and size["few"] < 0.2
    assert {"unpredict"} == {x for name in ("ramp", "columns") for x in coded_as(files[name])[0]} and size["ramp"] < 0.2 and size["columns"] < 0.6
    assert coded_as(files["cached"])[1] == 8 and size["cached"] < 0.6
    assert size["repeated"] < 0.2


def test_damaged_bits_of_one_image_are_refused():
    data = webp.encode(to_image(np.arange(64 * 9, dtype=np.uint8)))
    short = data[:60]
    short = short[:4] + (len(short) - 8).to_bytes(4, "little") + short[8:16] + (len(short) - 20).to_bytes(4, "little") + short[20:]
    with pytest.raises((ValueError, IndexError)):
        webpbatch.decode_many([data, short])


def test_high_payloads_become_wide():
    n = 64 * 20_000
    image = to_image(np.arange(n, dtype=np.uint8))
    assert image.shape[0] <= webp.MAX_SIDE
    assert np.array_equal(webp.decode(webp.encode(image)).reshape(-1)[:n], np.arange(n, dtype=np.uint8))
    assert [padded_size(x) for x in (0, 1, 64, 65)] == [64, 64, 64, 128]


def test_damaged_files_are_refused():
    data = webp.encode(to_image(np.zeros(64, np.uint8)))
    for bad in (b"", data[:40], b"JUNK" + data[4:]):
        with pytest.raises((ValueError, IndexError, Exception)):
            webp.decode(bad)
