import io
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql.functions import countDistinct, spark_partition_id
from tokenizers import Tokenizer

from logloom.llm import token_store

from .conftest import thue_morse

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("widths", [(8, 8, 16), (8, 8, 8, 8), (16, 16), (16, 8, 8)])
def test_random_access(widths):
    rng = random.Random(3)
    wide = np.array([rng.choice([0, 5, 255, 256, 65535, 65536, 2**31, 2**32 - 1]) for _ in range(3000)], np.uint32)
    for ids in (wide, wide[:0], wide % 200, wide % 60000, wide[:1], wide[:512], wide[:513]):
        k = len(ids) // 2
        r = token_store.Reader(io.BytesIO(token_store.packed([None, 7], np.array([0, k, len(ids)]), ids, widths)))
        assert [r[i] for i in range(len(ids))] == ids.tolist()
        assert r.documents()[0] == [None, 7] and r.documents()[1].tolist() == [0, k, len(ids)]
        for _ in range(100):
            a = rng.randint(0, len(ids))
            b = rng.randint(a, len(ids))
            assert r.slice(a, b).tolist() == ids[a:b].tolist()
        with pytest.raises(IndexError):
            r[len(ids)]


def test_reads_few_bytes_for_one_id():
    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            got = super().read(size)
            Counted.n += len(got)
            return got

    ids = np.arange(200_000, dtype=np.uint32)
    r = token_store.Reader(Counted(token_store.packed([1], np.array([0, len(ids)]), ids)))
    Counted.n = 0
    assert r[199_999] == 199_999 and Counted.n < 400


def test_refuses_other_files():
    with pytest.raises(ValueError, match="token file"):
        token_store.Reader(io.BytesIO(b"x" * 100))
    with pytest.raises(ValueError, match="widths"):
        token_store.packed([], np.array([0]), np.array([], np.uint32), (4, 28))


def test_chunks_are_independent(library):
    rng = random.Random(4)
    alphabet = ["a", "b", "é", " ", " ", " ", "\n", "\t", "\xa0", " ", "　", "1", "!", "'s", "日", "Ж", "\x1c", "\x85", " ", "​", "﻿", "𠀋", "<|endoftext|>", "Á", "×"]
    texts = ["", "a\n \nb", "a\n  b", "　 x", "été écrit là", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000))]
    raw = [t.encode() for t in texts]
    ids, first = token_store._Tokenizer(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files_and_query(spark, library, make_docs, odd_texts, tmp_path):
    texts = [*odd_texts, *(f"document {i} text" for i in range(40))]
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    docs = make_docs([texts[i] for i in order], order).repartition(3)
    to = tmp_path.as_uri()
    manifest = token_store.written(docs, PATH, to, file_ids=50)
    assert manifest.count() > 4
    got = {r.doc_id: r for r in token_store.read(manifest).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        with open(r.path.removeprefix("file://").replace("file:", ""), "rb") as f:
            one = token_store.Reader(f)
            names, first = one.documents()
            k = names.index(i)
            assert one.slice(int(first[k]), int(first[k + 1])).tolist() == ids and one[int(first[k])] == ids[0]
        at += len(ids)
    assert len(list((Path(tmp_path) / "files").glob("*.dac"))) == manifest.count()
    assert token_store.report(docs.limit(0), PATH).count() == 0


def test_files_are_read_back_by_many_tasks(spark, make_docs, tmp_path):
    """Under adaptive execution too the number of reading tasks grows with the files."""
    docs = make_docs([f"document {i} text with a few words" for i in range(400)]).repartition(4)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    for ids in (300, 60):
        manifest = token_store.written(docs, PATH, f"{tmp_path.as_uri()}/{ids}", file_ids=ids)
        files = manifest.count()
        rows = token_store.read(manifest).withColumn("task", spark_partition_id())
        tasks = rows.groupBy("task").agg(countDistinct("path").alias("files")).collect()
        assert len(tasks) == -(-files // token_store.READ_FILES) and max(r.files for r in tasks) <= token_store.READ_FILES + 1
        assert rows.agg(countDistinct("doc_id")).first()[0] == 400


def test_words_that_power_hashes_confuse(make_docs, library):
    texts = [t for n in (10, 11, 12) for t in thue_morse(n)]
    got = {r.doc_id: r.ids_crc32 for r in token_store.report(make_docs(texts), PATH).collect()}
    for i, t in enumerate(texts):
        assert got[i] == zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())


def test_null_and_repeated_ids(make_docs, library):
    docs = make_docs(["b", "a", "x y", "x y"], [None, 5, 3, 3])
    got = sorted((tuple(r) for r in token_store.report(docs, PATH).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [None, 3, 3, 5] and got[1][2:] == got[2][2:]
    assert [g[1] for g in got] == [sum(h[2] for h in got[:i]) for i in range(4)]
