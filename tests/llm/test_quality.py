import math
import random
import zlib

import numpy as np
import pyarrow as pa

from logloom.llm import quality
from logloom.llm.textarrays import blocks

from .conftest import prose


def corpus(n):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        good = rng.random() < 0.8
        text = prose(rng, rng.randint(5, 80))
        if not good:
            text = rng.choice([lambda t: "!! ".join(t.upper().split()), lambda t: " | ".join(t.split()), lambda t: " ".join(w for w in t.split()[:5] for _ in range(12)), lambda t: "".join(f"{w}{rng.choice(['###', '%%%'])} " for w in t.split())])(text)
        rows.append((i, text, int(good)))
    return rows


def test_features_have_unit_length_and_depend_on_the_text_alone():
    texts = ["a b c", "", "A b, c!!", "a b c", "w " * 500]
    for limit in (1 << 20, 4):
        got = {}
        for a, _, data, offsets in blocks(pa.array(texts), limit):
            i, x, first = quality.features(data, offsets)
            for k in range(len(first) - 1):
                own = slice(first[k], first[k + 1])
                got[a + k] = dict(zip(i[own].tolist(), x[own].tolist(), strict=True))
        assert got[0] == got[3] and got[1] == {} and got[0] != got[2]
        assert all(abs(sum(v * v for v in g.values()) - 1) < 1e-9 for k, g in got.items() if k != 1)


def test_learns_and_keeps_out_the_held_out(spark, make_docs):
    rows = corpus(900)
    docs = make_docs([t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 10], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(got) == 900
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    unseen = [(q, got[i].score) for i, _, q in rows if got[i].held_out or i % 10 == 0]
    assert np.mean([(s >= 0.3) == q for q, s in unseen]) > 0.95
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1 - q if got[i].held_out else q, 0) for i, _, q in rows if i % 10], "doc_id long, quality int, toxic int")
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in quality.report(docs.repartition(3), flipped).collect()}


def test_bound_on_training_rows(spark, make_docs):
    rows = corpus(300)
    docs = make_docs([t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    few = quality.trained(docs, labels, max_rows=60)
    assert 0 < np.count_nonzero(few) < np.count_nonzero(quality.trained(docs, labels))


def test_odd_texts_and_labels(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts, [None, *range(1, len(odd_texts))]).selectExpr("*", "'x' as Score")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (99, 0)], "doc_id long, quality int")
    got = quality.report(docs, labels).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    none = labels.limit(0)
    assert {r.score for r in quality.report(docs, none).collect()} == {0.5}
    kept = quality.accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(odd_texts)
    assert quality.report(docs.limit(0), labels).count() == 0


def test_updates_are_those_of_a_plain_loop(spark, make_docs):
    """FTRL-proximal weight by weight, in the order of the hash, over texts that fill several pieces."""
    rows = corpus(60)
    docs = make_docs([t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = quality.trained(docs, labels, epochs=2)
    seen = sorted((r.order, r.doc_id, r.piece, r.label, r.i, r.x) for r in quality.examples(docs, labels).collect())
    assert {r[1] for r in seen} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5}
    z, n = {}, {}

    def weight(k):
        v = z.get(k, 0.0)
        return 0.0 if abs(v) <= 0.02 else -(v - math.copysign(0.02, v)) / (1.0 + math.sqrt(n[k]) + 0.02)

    for _ in range(2):
        for _, doc, _, label, _, _ in [r for r in seen if r[2] == 0]:
            x = {i: v for r in seen if r[1] == doc for i, v in zip(r[4], r[5], strict=True)} | {1 << quality.BITS: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
            for k, v in x.items():
                g, old, w = (p - label) * v, n.get(k, 0.0), weight(k)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) * w
                n[k] = old + g * g
    want = np.zeros(len(got))
    for k in z:
        want[k] = weight(k)
    assert np.allclose(got, want, atol=1e-9) and np.count_nonzero(want) > 50


def test_one_text_stands_for_a_repeated_id_and_long_texts_have_pieces(spark, make_docs, monkeypatch):
    rows = corpus(40)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    docs = make_docs([t for _, t, _ in rows])
    whole = quality.trained(docs, labels)
    assert (whole == quality.trained(docs.unionByName(docs).repartition(3), labels)).all()
    other = make_docs([f"other {i}" for i in range(300)], [1] * 300)
    assert quality.examples(docs.unionByName(other), labels).where("doc_id = 1").count() <= 1
    monkeypatch.setattr(quality, "PIECE", 5)
    assert quality.examples(docs, labels).groupBy("doc_id").count().agg({"count": "max"}).first()[0] > 3
    assert (whole == quality.trained(docs, labels)).all()
