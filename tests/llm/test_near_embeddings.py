import math
import random

import numpy as np

from logloom.llm import near_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows, t):
    def usable(e, l):
        return l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    vectors = [np.array(e, np.float32).astype(float) if usable(e, l) else None for _, e, l, _ in rows]
    n = len(rows)
    parent, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= t:
                links[i] += 1
                links[j] += 1
                x, y = i, j
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[x] = y
    root = [i for i in range(n)]
    for i in range(n):
        while parent[root[i]] != root[i]:
            root[i] = parent[root[i]]
    least = {}
    for i in range(n):
        least[root[i]] = min(least.get(root[i], 1 << 62), rows[i][0])
    return sorted((rows[i][0], links[i], least[root[i]], rows[i][0] == least[root[i]]) for i in range(n))


def sample():
    rng = random.Random(3)
    rows = []
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    for i in range(500):
        c = rng.choice(centres)
        spread = rng.choice([0.0, 0.03, 0.1, 1.0])
        rows.append((i, [x + rng.gauss(0, spread) for x in c], rng.choice([0, 0, 0, 1, None]), "extra"))
    scale = [2.0 * x for x in rows[0][1]]
    odd = [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0], [1.0, 2.0], scale, rows[0][1], rows[0][1]]
    return rows + [(1000 + i, e, 0, "extra") for i, e in enumerate(odd)]


def test_matches_brute_force_for_any_cells_and_blocks(spark, monkeypatch):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, 0.98)
    assert max(w[1] for w in want) > 5
    for cell, block, copies in ((2000, 4096, 4.0), (20, 16, 4.0), (60, 7, 1e9), (8, 4096, 1e9)):
        monkeypatch.setattr(near_embeddings, "COPIES", copies)
        got = near_embeddings.near_duplicates(df, cell=cell, block=block)
        assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert sorted(tuple(r) for r in got.collect()) == want


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    assert near_embeddings.near_duplicates(none).count() == 0
    same = spark.createDataFrame([(7, [1.0, 1.0], "a"), (7, [1.0, 1.0], "a"), (9, [2.0, 2.0], "a")], "vec_id long, embedding array<double>, label string")
    assert sorted(tuple(r) for r in near_embeddings.near_duplicates(same).collect()) == [(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False)]


def test_every_cell_in_reach_is_visited():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x[150:] = x[:150] + rng.normal(size=(150, 6)) * 0.05
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    pivots = near_embeddings._farthest(unit, 12)
    r = 0.3
    row, cell, own = near_embeddings._reached(x, pivots, r)
    at = {(a, b): o for a, b, o in zip(row.tolist(), cell.tolist(), own.tolist(), strict=True)}
    home = {a: b for (a, b), o in at.items() if o}
    assert len(home) == 300
    near = np.argwhere(np.linalg.norm(unit[:, None] - unit, axis=2) <= r)
    meetings = [sum((i, c) in at and (j, c) in at and (at[i, c] or at[j, c]) for c in range(len(pivots))) for i, j in near.tolist() if i < j]
    assert meetings and set(meetings) == {1}


def test_large_cells_are_split_again(spark, monkeypatch):
    """Levels of pivots until cells are small; structured vectors get few copies."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 1200)] + rng.normal(size=(1200, 16)) * 0.05
    monkeypatch.setattr(near_embeddings, "MAX_PIVOTS", 4)
    nodes = spark.createDataFrame([(i, "a", 16, 1, v.tolist()) for i, v in enumerate(x)], "node long, label string, dim int, m long, vec array<double>")
    levels = []
    written = near_embeddings.stored
    monkeypatch.setattr(near_embeddings, "stored", lambda df, to: levels.append(written(df, to)) or levels[-1])
    near_embeddings.links(nodes, 0.98, near_embeddings.shared_dir(spark), cell=50).count()
    assert len(levels) >= 2
    sizes = [r["count"] for r in levels[-1].groupBy("cell").count().collect()]
    assert sum(sizes) < 4 * 1200 and max(sizes) < 600
