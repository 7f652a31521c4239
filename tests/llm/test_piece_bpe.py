import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from logloom.llm import piece_bpe
from logloom.llm.chunkcache import ChunkCache

from .conftest import thue_morse

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def random_texts(n):
    rng = random.Random(1)
    out = ["", " ", "a  b", " a", "a ", "\n", "▁x", " ▁y", "\x00", "a" * 1500, "ab" * 700, " " * 50, "�", "▁" * 20, "日本語 𠀋"]
    for _ in range(n):
        out.append("".join(rng.choice("abcdefgh  eee tttt ▁\n\tésx09€𠀋日本") for _ in range(rng.randint(0, 60))))
        out.append("".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x7FF), rng.randint(0x800, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(1, 30))))
    out += ["".join(rng.choice("abcdefgheeetttt") for _ in range(rng.randint(100, 900))) for _ in range(30)]
    return out


def test_encodes_and_decodes_like_the_library(library):
    texts = random_texts(600)
    ids, first = piece_bpe.Encoder(piece_bpe.load(PATH)).encode(*block(texts))
    want = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want
    assert piece_bpe.load(PATH).decode(ids, first) == [library.decode(w).encode() for w in want]


def test_words_that_power_hashes_confuse(library, make_docs):
    texts = [t for n in (10, 11, 12) for t in thue_morse(n)]
    enc = piece_bpe.Encoder(piece_bpe.load(PATH))
    assert [enc.encode(*block([t]))[0].tolist() for t in texts] == library.encode(texts)


def test_equal_hashes_are_told_apart_by_bytes(library, monkeypatch):
    monkeypatch.setattr("logloom.llm.chunkcache.hashes", lambda values, first, size: (size % 3).astype(np.uint64))
    texts = random_texts(40)
    enc = piece_bpe.Encoder(piece_bpe.load(PATH))
    for _ in range(2):
        assert [enc.encode(*block([t]))[0].tolist() for t in texts] == library.encode(texts)


@pytest.mark.parametrize("letters", ["ab", "abcdefgheeetttt", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "theandingr", "0", "日本語のは"])
def test_words_of_a_hundred_thousand_symbols(library, letters):
    rng = random.Random(5)
    text = "".join(rng.choice(letters) for _ in range(100_000))
    enc = piece_bpe.Encoder(piece_bpe.load(PATH))
    assert enc.encode(*block([text]))[0].tolist() == library.encode(text)


def test_merges_that_make_an_earlier_pair(library):
    """Pieces whose parts rank after them: the simultaneous merges have to stop there."""
    m = piece_bpe.load(PATH)
    rng = random.Random(6)
    known = [p for p in m.pieces[300:] if p.isascii() and p.isalpha() and len(p) > 1]
    words = ["".join(rng.choice(known) for _ in range(rng.randint(2, 60))) for _ in range(4000)]
    enc = piece_bpe.Encoder(m)
    ids, first = enc.encode(*block(words))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == library.encode(words)


def test_decodes_any_ids(library):
    rng = random.Random(3)
    seqs = [[rng.choice([0, 1, 2, 3, 50, 200, 230, 160, 130, 28705, 28724, 300, 400, 255]) for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    flat, first = np.array([x for s in seqs for x in s], np.int32), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    assert piece_bpe.load(PATH).decode(flat, first) == [library.decode(s).encode() for s in seqs]


def test_cache_that_is_emptied_gives_the_same(library):
    texts = random_texts(100)
    enc = piece_bpe.Encoder(piece_bpe.load(PATH))
    enc.cache = ChunkCache(enc.cache.encode_strings, remembered=5)
    got = []
    for t in texts:
        got.append(enc.encode(*block([t]))[0].tolist())
    assert got == library.encode(texts)


def test_query(library, make_docs, odd_texts):
    docs = make_docs(odd_texts).selectExpr("*", "1 as Ids")
    for r in piece_bpe.report(docs, PATH).collect():
        ids = library.encode(odd_texts[r.doc_id] or "") + [2]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    two = piece_bpe.decoded(piece_bpe.encoded(docs, PATH, end_id=False), PATH)
    assert two.columns == [*docs.columns[:-1], "ids", "decoded"]
    assert {r.doc_id: r.ids for r in two.collect()} == {i: library.encode(t or "") for i, t in enumerate(odd_texts)}
    assert piece_bpe.report(docs.limit(0), PATH).count() == 0
