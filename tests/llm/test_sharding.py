from collections import Counter

import pytest

from logloom.llm import sharding


def plain_fill(names, m):
    """The table by whole preference lists."""
    import hashlib

    order = []
    for name in names:
        h = hashlib.md5(name.encode()).digest()
        a, s = int.from_bytes(h[:8]) % m, int.from_bytes(h[8:]) % (m - 1) + 1
        order.append([(a + k * s) % m for k in range(m)])
    table, nxt = {}, [0] * len(names)
    while len(table) < m:
        for i in range(len(names)):
            while order[i][nxt[i]] in table:
                nxt[i] += 1
            table[order[i][nxt[i]]] = i
            if len(table) == m:
                break
    return [table[k] for k in range(m)]


@pytest.mark.parametrize(("n", "m"), [(1, 2), (3, 13), (7, 101), (64, 6007)])
def test_fill(n, m):
    names = [f"s{i}" for i in range(n)]
    table = sharding.lookup_table(names, m)
    assert table == plain_fill(names, m)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_keys_move_when_a_shard_goes():
    names = [f"s{i}" for i in range(20)]
    before, after = sharding.lookup_table(names, 10_007), sharding.lookup_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.08 * 10_007


@pytest.mark.parametrize("bad", [([], 13), (["a", "a"], 13), (["a"], 12), (["a"] * 3, 2)])
def test_refuses(bad):
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(*bad)


def test_placement(spark, tmp_path):
    import hashlib

    names = ["a", "b", "c"]
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7), (2, None)], "doc_id long, shard int")
    got = sharding.placed(df, "doc_id", names, 101)
    assert got.columns == ["doc_id", "slot", "shard"] and got.count() == 4
    table = sharding.lookup_table(names, 101)
    for r in got.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, table[slot])
    assert sharding.placed(df.limit(0), "doc_id", names, 101).count() == 0
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    sharding.write_shards(rows, str(tmp_path / "out"), "doc_id", names, 101, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("doc_id", "shard").collect()) == sorted(tuple(r) for r in sharding.placed(rows, "doc_id", names, 101).select("doc_id", "shard").collect())
