import hashlib
import pickle
import random

from logloom.llm import decontaminate

from .conftest import alnum_words, prose


def brute(docs, items):
    strings = {}
    for key, text in items:
        w = alnum_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            strings.setdefault(tuple(w[i : i + n]), set()).update([] if key is None else [str(key)])
    out = []
    for key, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                if (got := strings.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case(odd_texts):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(8, 30))) for i in range(20)]
    items += [(3, items[4][1]), (100, "One"), (101, "two words"), (102, ""), (103, None), (None, prose(rng, 14)), (104, "the the the the the the the the the the the"), (105, items[5][1])]
    texts = list(odd_texts)
    for _ in range(120):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randint(0, max(0, len(w) - 5))
            parts += [" ".join(w[a : a + rng.randint(5, 30)]).upper().replace(" ", rng.choice([" ", " - ", "\n"])), prose(rng, rng.randint(0, 9))]
        texts.append(" ".join(parts))
    texts += ["the " * 40, "one", "TWO, words!"]
    return texts, items


def test_matches_brute_force(spark, make_docs, odd_texts, monkeypatch):
    texts, items = case(odd_texts)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute(list(enumerate(texts)), items)
    assert sum(w[5] for w in want) > 30
    docs = make_docs(texts)
    assert sorted((tuple(r) for r in decontaminate.report(docs, table).collect()), key=repr) == want
    # a benchmark beyond one set of tables is searched in parts, and long items in runs
    monkeypatch.setattr(decontaminate, "RUN_WINDOWS", 7)
    assert len(decontaminate.compiled(table, part_windows=40)) > 5
    assert sorted((tuple(r) for r in decontaminate.report(docs, table, part_windows=40).collect()), key=repr) == want


def test_clean_keeps_columns_and_clashing_names(spark, make_docs, odd_texts):
    texts, items = case(odd_texts)
    table = spark.createDataFrame(items, "item_id long, text string")
    bad = {w[0] for w in brute(list(enumerate(texts)), items) if w[5]}
    for docs in (make_docs(texts), make_docs(texts).selectExpr("*", "'mine' as N_words", "1 as hit_items")):
        got = decontaminate.clean(docs, table)
        assert got.schema == docs.schema and {r.doc_id for r in got.collect()} == set(range(len(texts))) - bad


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs(["a b c", None])
    assert [r.contaminated for r in decontaminate.report(docs, none).collect()] == [False, False]
    assert decontaminate.report(docs.limit(0), none).count() == 0


def test_tables_are_small(spark):
    """What a worker holds follows the bound on test strings, not the benchmark; items of one text are one."""
    rng = random.Random(9)
    items = spark.createDataFrame([(i, " ".join(str(rng.randrange(10**6)) for _ in range(1000))) for i in range(60)] + [(i, "one text that many of the items share word for word") for i in range(1000, 1900)], "item_id long, text string")
    paths = decontaminate.compiled(items, part_windows=20_000)
    assert len(paths) == 3
    sizes = [len(pickle.dumps(decontaminate._loaded(p))) for p in paths]
    assert max(sizes) < 40_000 * 60 + (6 << 20)
    found = decontaminate.report(spark.createDataFrame([(1, "x one text that many of the items share word for word y")], "doc_id long, text string"), items).first()
    assert (found.n_hit, found.n_items) == (11, 900)


def test_clean_of_nothing_and_repeats(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    item = spark.createDataFrame([(1, "these five words are bad")], "item_id long, text string")
    docs = make_docs(["these five words are bad", "these five words are bad", None, "", "fine", "fine"], [1, 1, 2, 3, 4, 4]).selectExpr("*", "7 as __row", "8 as __text")
    assert decontaminate.clean(docs, none).count() == 6 and decontaminate.clean(docs.limit(0), item).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(docs, item).collect()) == [2, 3, 4, 4] and decontaminate.clean(docs, item).schema == docs.schema
