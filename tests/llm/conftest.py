import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were".split()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum_words(text):
    return ALNUM.findall(lower(text))


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "a", "ing", "é", ","]) for _ in range(n))


def thue_morse(n):
    """The word of 2**n letters that a hash by powers modulo 2**64 can't tell from its complement."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, odd characters, repeated."""
    rng = random.Random(4)
    long = prose(rng, 60_000)
    return [None, "", "   \n\t ", long, "x" * 30_000, "日本語テスト 𠀋 é́", "a\x00b\x1c c\x85d  e　f", "Same text twice here ok", "Same text twice here ok", "▁▁ a  b   ", "<|endoftext|> <s>", "�"]
