"""The driver fits the language field on a sample that it holds in pieces."""

import tracemalloc

import numpy as np

from spanveil.llm import language_crf as L


def _texts() -> list[str]:
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 12, 3000)], object)
    return ["", "Äß, 12 — x"] + [" ".join(rng.choice(words, 1200)) for _ in range(500)]


def test_a_sample_in_pieces_has_the_words_of_the_whole():
    texts = _texts()[:200]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    whole, own = L._Piece(body, np.r_[0, np.cumsum([len(t.encode()) for t in texts])]), L._Sample(texts)
    for a, b in ((whole.keys, own.keys), (whole.back, own.back), (whole.lettered, own.lettered), (whole.words.row, own.words.row), (whole.words.first, own.words.first), (whole.words.count, own.words.count)):
        assert np.array_equal(a, b)
    field = L.Field(["a", "b"], whole.keys[:50])
    field.gram[:] = np.random.default_rng(1).random(field.gram.shape)
    assert np.array_equal(field.emissions(whole), field.emissions(own))
    assert not len(L._Sample([]).back)


def test_the_driver_holds_no_array_as_long_as_the_sample():
    texts = _texts()
    field = L.Field(["a", "b"], np.zeros(0, np.uint64))
    L.set_floor(field, texts[:3], ["a", "b", "a"])
    tracemalloc.start()
    L.set_floor(field, texts, ["a", "b"] * (len(texts) // 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(peak / 1e6)
    assert peak < 25 * sum(map(len, texts))
