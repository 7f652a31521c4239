import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import dedup, geo, merge, partitioning, rebalance, reports, skew, validate
from logloom.plans import pipeline


def tuples(spark, rows):
    return spark.createDataFrame(rows, "ip string, site_id int")


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(1)
    return [(f"{rng.randint(1, 250)}.{rng.randint(0, 3)}.0.{rng.randint(0, 3)}", rng.randint(1, 4)) for _ in range(1500)]


def test_distincts_and_counts(spark, some):
    t = tuples(spark, some)
    lines = spark.range(2000).toDF("x")
    row = dedup.pipeline_counts(lines, t).first()
    local, ips = len(set(some)), len({i for i, _ in some})
    assert (row.rows_read, row.ip_local, row.ip_global, row.skipped) == (2000, local, ips, local - ips)
    want = {i: sorted({s for j, s in some if j == i}) for i, _ in some}
    for sites in (None, [1, 2, 3, 4]):
        assert {r.ip: r.source_sites for r in dedup.global_distinct(t, sites).collect()} == want
    with pytest.raises(ValueError, match="mask"):
        dedup.global_distinct(t, [1, 63])


def test_empty_input(spark):
    t = tuples(spark, [])
    row = dedup.pipeline_counts(t, t).first()
    assert tuple(row) == (0, 0, 0, 0)
    assert pipeline.store(t).count() == 0
    assert skew.skew_factor(skew.received_counts(partitioning.hash_routed(t, 4), 4)).first().asDict() == {"skew": 0.0, "level": "low"}
    assert partitioning.quantile_bounds(partitioning.sampled(t, 10), 4).first().bounds == partitioning.equal_width_bounds(4)


def test_result_does_not_depend_on_routing(spark, some):
    t = dedup.local_distinct(tuples(spark, some))
    want = {tuple(r[:5]) for r in pipeline.store(t).collect()}
    for n, strategy in ((1, "hash"), (3, "hash"), (4, "range")):
        config = pipeline.PipelineConfig(n_reducers=n, strategy=strategy)
        records = pipeline.partition_records(pipeline.routed(t, config))
        assert {tuple(r[:5]) for r in merge.merged(records).collect()} == want


def test_chunk_hit_rates_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2), str(rng.randint(0, 40)), s, i) for s in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "rid int, ip string, site_id int, line_no int")
    got = {(r.rid, r.chunk_id): (r.received, r.local_dup, r.global_dup, r.hit_rate) for r in dedup.chunk_hit_rates(df, 16, ("site_id", "line_no")).collect()}
    want = {}
    for rid in range(3):
        mine, seen = sorted((x for x in rows if x[0] == rid), key=lambda x: (x[2], x[3])), set()
        for c in range(0, len(mine), 16):
            here, local, glob = set(), 0, 0
            for _, ip, _, _ in mine[c : c + 16]:
                local += ip in here
                glob += ip in seen
                here.add(ip)
                seen.add(ip)
            n = len(mine[c : c + 16])
            want[rid, c // 16] = (n, local, glob, round(glob / n, 4))
    assert got == want


def test_quantile_bounds_take_the_place_not_the_percentile(spark):
    sample = spark.createDataFrame([(i,) for i in range(1, 9)], "ipn bigint")
    assert partitioning.quantile_bounds(sample, 4).first().bounds == [0, 3, 5, 7, 2**32]


def test_range_rid(spark):
    df = spark.createDataFrame([(v,) for v in (0, 2, 3, 4, 5, 99, 2**33)], "n bigint")
    assert [r.rid for r in df.select("n", partitioning.range_rid(F.col("n"), [0, 3, 5, 7, 2**32]).alias("rid")).orderBy("n").collect()] == [0, 0, 1, 1, 2, 3, 3]


def test_moves_of_a_traced_example():
    moves = rebalance.planned_moves({0: 1387, 1: 1372, 2: 1400, 3: 729})
    assert [(m.hot, m.cold, m.n) for m in moves] == [(2, 3, 89)]
    assert round(moves[0].before, 4) == 0.5491 and round(moves[0].after, 4) == 0.4656
    assert rebalance.planned_moves({0: 0, 1: 0}) == [] and rebalance.planned_moves({0: 1, 1: 0}) == []


def test_rebalance_moves_the_highest_addresses(spark):
    rows = [(f"{a}.0.0.0", 1, 0) for a in range(1, 31)] + [("40.0.0.0", 1, 1)]
    df = spark.createDataFrame(rows, "ip string, site_id int, rid int")
    out, moves = rebalance.rebalanced(df, 2)
    rids = {r.ip: r.rid for r in out.collect()}
    assert len(rids) == 31 and moves[0].n == (30 - 15) // 2
    moved = {ip for ip, _, old in rows if rids[ip] != old}
    total = sum(m.n for m in moves if m.hot == 0)
    assert moved == {f"{a}.0.0.0" for a in range(31 - total, 31)}
    assert rebalance.steal_stats(moves)["total_steals"] == len(moves)


def test_hot_cold_ties(spark):
    counts = spark.createDataFrame([(0, 5), (1, 7), (2, 7), (3, 5)], "rid int, received bigint")
    assert tuple(skew.hot_cold(counts).first()) == (1, 7, 0, 5)


def test_merge_keeps_the_highest_rid_and_upsert_is_idempotent(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (2, "a", "y"), (1, "a", "z"), (1, None, "n"), (0, "b", "q")], "rid int, ip string, city string")
    merged = merge.merged(rows)
    assert {tuple(r) for r in merged.collect()} == {("a", "y"), ("b", "q")}
    new = spark.createDataFrame([("a", "w"), ("c", "v")], "ip string, city string")
    once = merge.upserted(merged, new)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in merge.upserted(once, new).collect()} == {("a", "w"), ("b", "q"), ("c", "v")}


def test_compat_sites_are_the_partitions(spark):
    df = spark.createDataFrame([("1.1.1.1", 1, 0), ("2.2.2.2", 3, 0), ("3.3.3.3", 2, 1)], "ip string, site_id int, rid int")
    got = {r.ip: r.source_sites for r in pipeline.partition_records(df, True).collect()}
    assert got == {"1.1.1.1": [1, 3], "2.2.2.2": [1, 3], "3.3.3.3": [2]}


def test_validation(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "ip string") for v in (["1", "2"], ["2", "3", "4"]))
    none = a.limit(0)
    assert tuple(validate.report(a, b).first()) == (2, 3, 1, 2, False)
    assert validate.report(a, a).first().passed and not validate.report(none, none).first().passed
    assert validate.report(none, none, allow_empty=True).first().passed


def test_range_geo_prefers_the_narrowest_network(spark):
    networks = spark.createDataFrame([(0, 2**32 - 1, "Wide", "", None, 1.0), (1 << 24, (2 << 24) - 1, None, "Town", 2.0, None)], "lo bigint, hi bigint, country string, city string, latitude double, longitude double")
    others = ["abc", "1.2.3", "999.1.2.3", "1.2.3.4.5", "01.2.3.4", "", "1.2.3.4\n"]
    ips = spark.createDataFrame([(x,) for x in ("1.2.3.4", "9.9.9.9", *others)], "ip string")
    got = {r.ip: tuple(r)[1:] for r in geo.with_range_geo(ips, networks).collect()}
    assert got["1.2.3.4"] == ("Unknown", "Town", 2.0, 0.0) and got["9.9.9.9"] == ("Wide", "Unknown", 0.0, 1.0)
    synthetic = {r.ip: tuple(r)[1:] for r in geo.with_synthetic_geo(ips).collect()}
    assert all(got[x] == synthetic[x] for x in others)


def test_range_geo_against_a_loop(spark):
    rng = random.Random(7)
    networks = []
    for _ in range(400):
        lo = rng.randrange(1 << 32)
        networks.append((lo, min(2**32 - 1, lo + rng.choice([0, 1, 63, 64, 65, 4000, 1 << 18, 3 << 24, rng.randrange(1 << 32)])), f"C{len(networks)}", "x", 1.0, 2.0))
    numbers = [rng.randrange(1 << 32) for _ in range(200)] + [n for lo, hi, *_ in networks[:150] for n in (lo, hi)]
    ips = spark.createDataFrame([(".".join(str(n >> s & 255) for s in (24, 16, 8, 0)),) for n in numbers], "ip string").distinct()
    got = {r.ip: r.country for r in geo.with_range_geo(ips, spark.createDataFrame(networks, "lo bigint, hi bigint, country string, city string, latitude double, longitude double")).collect()}
    for n in numbers:
        fit = [(hi - lo, lo, c) for lo, hi, c, *_ in networks if lo <= n <= hi]
        ip = ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
        assert got[ip] == min(fit)[2] if fit else not got[ip].startswith("C") or got[ip] in ("China", "Canada")


def test_routing_is_not_computed_in_the_scan(spark, some):
    """The join on rid must not bring the hash into a filter below the distinct."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from logloom.sources import events_log, log_tuples

    routed = partitioning.hash_routed(dedup.local_distinct(log_tuples(events_log(events))), 4)
    plan = skew.received_counts(routed, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "aggregate(" in line for line in plan.splitlines()) and plan.count("aggregate(") == 1


def test_moves_from_a_partition_that_has_received(spark, monkeypatch):
    """One that gives after it has received is numbered anew; counts follow the plan."""
    rng = random.Random(8)
    rows = [(f"{rng.randint(1, 250)}.{rng.randint(0, 255)}.0.{i % 256}", 1, rid) for rid, n in ((0, 300), (1, 40), (2, 30), (3, 20)) for i in range(n)]
    planned = [rebalance.Move(0, 1, 150, 0, 0), rebalance.Move(0, 2, 20, 0, 0), rebalance.Move(1, 3, 60, 0, 0), rebalance.Move(0, 3, 5, 0, 0)]
    monkeypatch.setattr(rebalance, "planned_moves", lambda *a, **k: list(planned))
    out, moves = rebalance.rebalanced(spark.createDataFrame(rows, "ip string, site_id int, rid int"), 4)
    now = {k: [r[0] for r in rows if r[2] == k] for k in range(4)}
    number = lambda ip: [int(x) for x in ip.split(".")]
    for m in planned:
        now[m.hot].sort(key=lambda ip: (number(ip), ip))
        now[m.hot], gone = now[m.hot][: -m.n], now[m.hot][-m.n :]
        now[m.cold] += gone
    got = {k: sorted(r.ip for r in out.where(F.col("rid") == k).collect()) for k in range(4)}
    assert got == {k: sorted(v) for k, v in now.items()} and moves == planned


def test_weighted_sample_is_that_of_rows(spark):
    counts = spark.createDataFrame([("1.0.0.1", 1, 3), ("2.0.0.2", 1, 100_000), ("3.0.0.3", 2, 100_000)], "ip string, site_id int, n bigint")
    drawn = [r.ipn >> 24 for r in partitioning.weighted_sample(counts, 2000).collect()]
    assert len(drawn) == 2000 and drawn == [r.ipn >> 24 for r in partitioning.weighted_sample(counts, 2000).collect()]
    assert drawn.count(1) <= 3 and abs(drawn.count(2) - 1000) < 150
    assert partitioning.weighted_sample(counts.limit(1), 50).count() == 3


def test_chunks_of_empty_partitions(spark):
    df = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 2, 2)], "rid int, ip string, site_id int, line_no int")
    rates = dedup.chunk_hit_rates(df, 16, ("site_id", "line_no"), 3)
    assert {(r.rid, r.chunk_id, r.received, r.hit_rate) for r in rates.collect()} == {(0, 0, 0, 0.0), (1, 0, 2, 0.5), (2, 0, 0, 0.0)}
    assert {tuple(r) for r in dedup.chunk_summary(rates).collect()} == {(0, 1, 0.0, 0.0), (1, 1, 0.5, 0.5), (2, 1, 0.0, 0.0)}


def test_reports_of_boundaries_and_groups(spark):
    assert partitioning.boundary_report([0, 300, 2**32]) == "R0:0-43 | R1:44-255" and partitioning.boundary_report([]) == "no boundaries"
    routed = spark.createDataFrame([(0, "b"), (0, "a"), (1, "c")], "rid int, ip string")
    assert {r.rid: r.ips for r in partitioning.grouped_ips(routed).collect()} == {0: ["a", "b"], 1: ["c"]}
    with pytest.raises(ValueError, match="write_partitions"):
        partitioning.grouped_ips(routed, 1)
    assert merge.write_count(spark.createDataFrame([("a",), ("a",), (None,)], "ip string")) == 2


def test_addresses_that_are_none_have_a_fixed_place(spark):
    ips = spark.createDataFrame([("abc",), ("",)], "ip string")
    first = geo.with_synthetic_geo(ips).collect()
    assert sorted(first) == sorted(geo.with_synthetic_geo(ips).collect()) and all(r.country for r in first)


def test_format_check_of_nothing(spark):
    assert reports.format_check(spark.createDataFrame([], "site_id int, raw_line string")).count() == 0


def test_speedup_and_scale(spark):
    t = spark.createDataFrame([(2, 2.0), (1, 4.0)], "n int, seconds double")
    assert {tuple(r) for r in reports.speedup_table(t).collect()} == {(1, 4.0, 1.0, 100.0), (2, 2.0, 2.0, 100.0)}
    s = spark.createDataFrame([(1, 1.0), (2, 2.0)], "size int, seconds double")
    assert {r.sizeup for r in reports.scale_table(s, "sizeup").collect()} == {1.0, 2.0}
    assert {r.scaleup for r in reports.scale_table(s, "scaleup").collect()} == {1.0, 0.5}


def test_plan_aggregates_before_the_exchange_and_stays_in_the_jvm(spark, some):
    plan = pipeline.store(tuples(spark, some), [1, 2, 3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_bit_or" in plan and "ObjectHashAggregate" not in plan


def test_retries():
    calls, slept = [], []

    def task():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert pipeline.with_retries(task, pipeline.PipelineConfig(), slept.append) == 7 and slept == [1.5, 2.25]
    calls.clear()
    with pytest.raises(OSError):
        pipeline.with_retries(lambda: (_ for _ in ()).throw(OSError()), pipeline.PipelineConfig(), slept.append)
