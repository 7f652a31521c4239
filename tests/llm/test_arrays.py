import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import textarrays as ta

from .conftest import alnum_words, prose, spaced_words


def words_of(texts, kind, limit=1 << 20):
    out = []
    for _, _, data, offsets in ta.blocks(pa.array(texts, pa.string()), limit):
        w = ta.words(data, offsets, kind)
        for i in range(len(offsets) - 1):
            out.append([data[a:b].tobytes().decode("utf-8").lower() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    for kind, split in ((ta.ALNUM, alnum_words), (ta.SPACED, spaced_words)):
        assert [[w.lower() for w in ws] for ws in words_of(texts, kind, 16)] == [[w.lower() for w in split(t)] for t in texts]


def test_a_text_beyond_the_block_splits_like_others(monkeypatch):
    monkeypatch.setattr(ta, "BLOCK", 64)
    text = prose(random.Random(1), 400) + " " + "y" * 500 + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    whole = ta.words(data, np.array([0, len(data)]), ta.SPACED)
    monkeypatch.setattr(ta, "BLOCK", 1 << 20)
    one = ta.words(data, np.array([0, len(data)]), ta.SPACED)
    assert (whole.hash == one.hash).all() and (whole.start == one.start).all() and len(whole.hash) == 402


def test_hashes_depend_on_the_word_alone():
    data = b"Ab cd ab CD abcd"
    w = ta.words(np.frombuffer(data, np.uint8), np.array([0, 5, len(data)]), ta.SPACED)
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and len(set(w.hash.tolist())) == 3


def test_shingles_and_short_texts():
    texts = ["a b c d e f", "a b", "", "b a", "a b c d e"]
    _, _, data, offsets = next(ta.blocks(pa.array(texts)))
    w = ta.words(data, offsets, ta.SPACED)
    h, first = ta.ngram_hashes(w, 5, short=True)
    assert np.diff(first).tolist() == [2, 1, 0, 1, 1] and h[0] == h[first[4]] and h[first[1]] != h[first[3]]
    assert np.diff(ta.ngram_hashes(w, 5)[1]).tolist() == [2, 0, 0, 0, 1]
