import random

import numpy as np

from logloom.llm import jaccard_join
from logloom.llm.graph import components

from .conftest import prose, spaced_words, thue_morse


def shingles(text):
    w = spaced_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), key) if x is not None), default=None)
    return sorted(((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)), key=repr)


def corpus():
    rng = random.Random(9)
    passage = prose(rng, 40)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(3, 150)).split()
        for _ in range(rng.randint(1, 25)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(["new", "word", "x1"])
            if rng.random() < 0.3:
                w = w[: rng.randint(max(1, len(w) - 20), len(w))]
            texts.append(" ".join(w))
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(40)]
    texts += ["a b c", "a b c", "a b", "a b c d e", "a b c d e f", "A  b\tC d E"]
    rng.shuffle(texts)
    return texts


def test_matches_brute_force_for_any_blocks(make_docs, odd_texts):
    texts = [*odd_texts, *corpus()]
    want = brute(list(enumerate(texts)))
    assert sum(w[0] != w[2] for w in want) > 60
    docs = make_docs(texts).repartition(3)
    for block, hot in ((2048, 1 << 16), (9, 4), (3, 1)):
        got = jaccard_join.groups(docs, block=block, hot=hot)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_null_and_repeated_ids(make_docs):
    text = "one two three four five six seven"
    rows = [(None, text), (5, text), (5, "other words are here to be found"), (2, text), (None, None), (None, "only this one with a null id here")]
    got = jaccard_join.groups(make_docs([t for _, t in rows], [i for i, _ in rows]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_words_that_power_hashes_confuse(make_docs):
    texts = [t for n in (10, 11, 12) for t in thue_morse(n)]
    assert all(r.component_id == r.doc_id for r in jaccard_join.groups(make_docs(texts)).collect())


def test_a_large_group_of_near_copies_and_its_outliers(make_docs):
    """Texts that link with no pivot still meet those that do."""
    rng = random.Random(12)
    base = prose(rng, 120).split()
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(w))
    for k in range(1, 25):  # a chain that leads away from the group
        texts.append(" ".join([*(f"y{i}" for i in range(3 * k)), *base[3 * k :]]))
    want = brute(list(enumerate(texts)))
    for block in (16, 40):
        got = jaccard_join.groups(make_docs(texts).repartition(5), block=block)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_empty_table(make_docs):
    assert jaccard_join.groups(make_docs(["a"]).limit(0)).count() == 0
    assert [tuple(r) for r in jaccard_join.groups(make_docs([None])).collect()] == [(0, 0, 0)]


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(150):
        if sets and rng.random() < 0.7:
            old = sets[rng.integers(len(sets))]
            new = rng.integers(0, 2**63, rng.integers(0, max(1, len(old) // 6)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([rng.permutation(old)[len(new) // 2 :], new])))
        else:
            sets.append(np.unique(rng.integers(0, 2**63, rng.integers(1, 3000), dtype=np.uint64)))
    sets.sort(key=len)
    h, n = np.concatenate(sets), np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(n)])
    root = jaccard_join._may_link(n, jaccard_join._row_bitmaps(h, first), None)
    side = rng.integers(0, 2, len(sets))
    cross = jaccard_join._may_link(n, jaccard_join._row_bitmaps(h, first), side)
    exact = jaccard_join.connected(h, first, np.arange(len(sets)), None)
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (n[i] + n[j] - k):
                links += 1
                assert root[i] == root[j] and exact[i] == exact[j] and (side[i] == side[j] or cross[i] == cross[j])
    assert links > 20 and len(set(exact.tolist())) > 20


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(7, 7), (300, 299)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 200), 100), 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
