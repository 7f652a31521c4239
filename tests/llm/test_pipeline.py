import os
import random
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from logloom.llm import queries, quality, secret_scan

from .conftest import SCHEMA, prose
from .test_decontaminate import brute as hits
from .test_jaccard_join import shingles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_each_stage_against_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = read("documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "sentencepiece"]
    before = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        if k < 4:
            assert after.columns == corpus_pipeline.COLUMNS
            after = spark.createDataFrame(after.collect(), after.schema)
        rows = {r.doc_id: r for r in after.collect()}
        if k == 0:
            predicted = {r.doc_id: r.predicted for r in quality.report(docs, read("labels")).collect()}
            assert set(rows) == {i for i, p in predicted.items() if p} and rows
        elif k == 1:
            ids = sorted(before)
            sets = [shingles(before[i].text) for i in ids]
            gone = {ids[a] for a in range(len(ids)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
            assert set(rows) == set(ids) - gone  # each but the first of its group has an earlier link here
        elif k == 2:
            assert set(rows) == {h[0] for h in hits([(i, r.text) for i, r in before.items()], items) if not h[5]}
        elif k == 3:
            assert set(rows) == set(before)
            assert all(not secret_scan.findings(r.text) for r in rows.values())
            assert all(rows[i].text == r.text for i, r in before.items() if not secret_scan.findings(r.text))
        else:
            m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {i: r.ids for i, r in rows.items()} == {i: [*m.encode(r.text or ""), 2] for i, r in before.items()}
        if k in (0, 1, 2):
            assert all(rows[i] == before[i] for i in rows)
        docs, before = after, rows


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:2] == ["doc_id", "n_tokens"] and got.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in names]
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_held_out_is_by_checksum(spark):
    got = queries.op9_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_near_duplicate_filter_keeps_one_row_of_each_group(spark, make_docs):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (1, a), (1, a), (1, b), (2, b), (2, b + " more"), (None, c), (None, c), (None, a), (None, a + " more"), (7, c + " more"), (3, None), (3, ""), (3, ""), (None, " ")]
    got = corpus_pipeline.near_duplicate_filter(spark, make_docs([t for _, t in rows], [i for i, _ in rows]), SF)
    assert got.columns == corpus_pipeline.COLUMNS
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted([(1, a), (1, b), (7, c + " more"), (3, None), (3, ""), (3, ""), (None, " ")], key=key)
    lone = corpus_pipeline.near_duplicate_filter(spark, make_docs([a, b, b], [None, None, None]), SF)
    assert sorted(r.text for r in lone.collect()) == [a, b]


@pytest.fixture(scope="module")
def odd_tables(spark, odd_texts, tmp_path_factory):
    """Documents with null and repeated ids, null in any column, odd and very long texts, repeated rows and columns whose names stages use."""
    folder = tmp_path_factory.mktemp("odd")
    rng = random.Random(21)
    texts = [*odd_texts, *(prose(rng, 40) for _ in range(6)), "token = 'q8w7e6r5t4y3'"]
    ids = [None, None, 1, 1, 2, *range(3, len(texts) - 2)]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 else "s", None if k % 5 == 0 or t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += rows[-3:]
    extra = ["'x' as __row", "1 as __text", "2 as node", "3 as loc", "4 as score", "5 as secrets", "6 as Hit_Spans", "7 as ids", "8 as decoded", "9 as root"]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "some benchmark words that no text has"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, str(folder)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_every_stage_takes_odd_rows(spark, odd_tables, name, stage):
    docs, folder = odd_tables
    rows = docs.collect()
    out = stage(spark, docs, folder)
    got = out.collect()
    wide = {tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows}
    if name == "sentencepiece":
        assert len(got) == len(rows) and all(r.n_tokens >= 1 for r in got)
    else:
        assert out.columns == corpus_pipeline.COLUMNS
        if name != "secret_scan":
            assert {tuple(r) for r in got} <= wide
        if name in ("quality_classifier", "benchmark_decontamination", "secret_scan"):
            assert len(got) == len(rows) or name == "quality_classifier"
        if name == "ngram_jaccard_join":
            assert len([r for r in got if (r.text or "").strip()]) == len({t for t in (r.text for r in rows) if (t or "").strip()})
            assert len([r for r in got if not (r.text or "").strip()]) == len([r for r in rows if not (r.text or "").strip()])
    assert stage(spark, docs.limit(0), folder).count() == 0
