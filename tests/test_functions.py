import pytest
from pyspark.sql import functions as F

from logloom.functions import CITIES, combined_fields, fnv1a_64, fnv_mod, geo_columns, int_to_ip, ip_to_int, is_combined, memory_estimate, parse_ip, sample_ip


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


TEXTS = ["", "a", "foobar", "1.2.3.4", "255.255.255.255", "é", "日本", "x" * 300]


def test_fnv_matches_its_definition_and_published_vectors(spark):
    got = column(spark, TEXTS, "string", fnv1a_64)
    assert [g.hi << 32 | g.lo for g in got] == [fnv(t) for t in TEXTS]
    assert fnv("a") == 0xAF63DC4C8601EC8C and fnv("foobar") == 0x85944171F73967E8


@pytest.mark.parametrize("n", [1, 3, 4, 7, 1000])
def test_fnv_mod(spark, n):
    assert column(spark, TEXTS, "string", lambda c: fnv_mod(c, n)) == [fnv(t) % n for t in TEXTS]


def test_parse_ip_edge_cases(spark):
    lines = {"999.1.2.3 - - [": "999.1.2.3", "1.2.3.4567 x": "1.2.3.456", " 1.2.3.4 x": "", "": "", "host - -": "", "�1.2.3.4 x": "1.2.3.4", "1.2.3": "", None: ""}
    assert column(spark, list(lines), "string", parse_ip) == list(lines.values())


def test_sampler_is_stricter(spark):
    lines = ["1.2.3.4 x", '1.2.3.4 "GET', "1.2.3.4 - - [x"]
    assert column(spark, lines, "string", sample_ip) == ["", "1.2.3.4", "1.2.3.4"]


def test_ip_to_int(spark):
    ips = {"1.2.3.4": 16909060, "0.0.0.0": 0, "255.255.255.255": 2**32 - 1, "a.b": 0, "1.2.3": 0, "1.2.3.4.5": 16909060, "999.1.2.3": 999 << 24 | 1 << 16 | 2 << 8 | 3, "1.256.0.0": 1 << 24 | 256 << 16, None: 0}
    assert column(spark, list(ips), "string", ip_to_int) == list(ips.values())


def test_int_to_ip(spark):
    assert column(spark, [0, 16909060, 2**32 - 1], "bigint", int_to_ip) == ["0.0.0.0", "1.2.3.4", "255.255.255.255"]


def test_combined_format(spark):
    good = '1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a b HTTP/1.0" 200 - "http://x/" "Mozilla"'
    lines = [good, good + " 0.1", f"  {good} ", '1.2.3.4 - - [x] "GET / HTTP/1.1" 200 5', '1.2.3.4 - - [x] "get / HTTP/1.1" 200 5', "1.2.3.4", None]
    assert column(spark, lines, "string", is_combined) == [True, True, True, True, False, False, False]
    fields = column(spark, lines[:1] + lines[4:5], "string", combined_fields)
    assert fields[0].asDict() == {"ip": "1.2.3.4", "time": "10/Oct/2000:13:55:36 -0700", "method": "GET", "path": "/a b", "http": "1.0", "status": "200", "size": "-", "ref": "http://x/", "agent": "Mozilla"}
    assert fields[1] is None


def test_synthetic_geo_is_the_rounded_sum(spark):
    numbers = [0, 1, 51, 52, 53, 16909060, 2**32 - 1, 52 * 999 + 7, 52_000 * 999 + 13]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").withColumns(geo_columns(F.col("n"))).collect()
    for r in rows:
        country, city, lat, lon = CITIES[r.n % 52]
        assert (r.country, r.city) == (country, city)
        assert r.latitude == round(lat + (r.n // 52 % 1000) / 10000.0, 6)
        assert r.longitude == round(lon + (r.n // 52000 % 1000) / 10000.0, 6)
    assert len(CITIES) == 52 and len({c[0] for c in CITIES}) == 35


def test_memory_estimate(spark):
    row = spark.createDataFrame([(100.0, 1048576)], "d double, n bigint").select(*[c.alias(k) for k, c in memory_estimate(F.col("d"), F.col("n")).items()]).first()
    assert row.asDict() == {"log_buffer_mb": 150.0, "geo_db_mb": 60.0, "ip_set_mb": 80.0, "result_json_mb": 200.0, "overhead_mb": 50.0, "total_mb": 540.0}
