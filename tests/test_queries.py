import os

import duckdb
import pytest

from logloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if not sql:
        assert got
        return
    found = duck.execute(sql)
    at = [[d[0] for d in found.description].index(c) for c in names]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


def test_rebalanced_counts_follow_the_plan(spark):
    got = {r.rid: r.received for r in catalog.q32_rebalance_counts(spark, SF).collect()}
    before = {r.rid: r.received for r in catalog.q14_equal_width_counts(spark, SF).collect()}
    for m in catalog.rebalance.planned_moves(before):
        before[m.hot] -= m.n
        before[m.cold] += m.n
    assert got == before


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["ip", "country", "city", "latitude", "longitude", "source_sites"]
    assert set(e.oracle_sql()) <= set(e.queries())
