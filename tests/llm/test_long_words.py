"""Texts without spaces: the parts and the blocks give the ids that the whole words have."""

import random
import time

import numpy as np
import pytest

from chronolake.llm import sentencepiece_viterbi as sv

M = sv.model(sv.MODEL)


def whole(word):
    with np.errstate(over="ignore"):
        return sv.encode_equal(M, [word])[0].tolist()


def kinds(rng):
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(700))
    b64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(900))
    latin = "".join(rng.choice(["the", "ing", "ation", "er", "qu", "z", "é", "ß"]) for _ in range(300))
    mixed = "".join(rng.choice([cjk[:5], "the", "\U0001f600", "ひらがな", "ไทย", "a", "=="]) for _ in range(250))
    return [sv.META + cjk, b64, sv.META + latin, mixed, "a" * 3000, "漢" * 400, sv.META * 300]


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_long_words_have_the_ids_of_whole_ones(monkeypatch, block):
    monkeypatch.setattr(sv, "BLOCK", block)
    for seed in range(2):
        words = kinds(random.Random(seed))
        got = sv.encode_words(M, words)
        for w in words:
            assert got[w].tolist() == whole(w), w[:20]
            assert "".join(sv.cut(M, w)) == w
            with np.errstate(over="ignore"):
                assert sv.encode_long(M, w).tolist() == whole(w), w[:20]


def test_parts_are_cut_where_no_piece_crosses():
    word = "漢" * 300 + "the" + "字" * 300
    with np.errstate(over="ignore"):
        parts = sv.cut(M, word)
    assert max(map(len, parts)) < 10 and "".join(parts) == word


def test_unspaced_text_costs_about_what_spaced_text_does():
    rng = random.Random(1)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60_000))
    latin = [sv.META + "".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(10_000)]
    sv.encode_words(M, latin[:10])
    took = []
    for words in (latin, [cjk]):
        began = time.perf_counter()
        sv.encode_words(M, words)
        took.append(time.perf_counter() - began)
    # Some microseconds a character; a row of its own took a millisecond.
    assert took[1] < 60_000 * 20e-6, took
