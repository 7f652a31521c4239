"""Registered queries over an access log derived from the events table, with DuckDB SQL for the same rows.

The SQL restates each query on its own: addresses by another expression, FNV by
128-bit products, boundaries by list look-ups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SITES
from ..functions import CITIES, int_to_ip, ip_to_int, memory_estimate, parse_ip
from ..operators import dedup, geo, merge, partitioning, rebalance, reports, skew, validate
from ..scratch import folder
from ..sinks import write_csv, write_json_object
from ..sources import completed_partitions, events_log, log_tuples, read_json_store
from ..sources.logs import csv_lines, csv_tuples
from ..streaming import distinct_tuples
from . import file_catalog, pipeline

N = 4
SAMPLE = 2000


def _log(spark: SparkSession, sf_dir: str, variant: str = "balanced") -> DataFrame:
    return events_log(spark.read.parquet(f"{sf_dir}/events.parquet"), variant)


def _tuples(spark: SparkSession, sf_dir: str, variant: str = "balanced") -> DataFrame:
    return log_tuples(_log(spark, sf_dir, variant))


def _routed(spark: SparkSession, sf_dir: str, variant: str = "balanced") -> DataFrame:
    return partitioning.hash_routed(dedup.local_distinct(_tuples(spark, sf_dir, variant)), N)


# -- queries -----------------------------------------------------------------------


def q01_geo_store(spark, d):
    return pipeline.store(_tuples(spark, d), SITES)


def q02_parse_ip(spark, d):
    return validate.site_matches(_log(spark, d))


def q03_local_distinct(spark, d):
    return dedup.local_distinct(_tuples(spark, d)).groupBy("site_id").agg(F.count("*").alias("n"))


def q04_global_distinct(spark, d):
    return dedup.global_distinct(_tuples(spark, d), SITES)


def q05_pipeline_counts(spark, d):
    return dedup.pipeline_counts(_log(spark, d), _tuples(spark, d))


def q06_fnv_rid(spark, d):
    return partitioning.hash_routed(_tuples(spark, d).select("ip").distinct(), N)


def q07_rid_received_counts(spark, d):
    return skew.received_counts(_routed(spark, d), N)


def q08_rid_unique_share(spark, d):
    return skew.unique_share(_routed(spark, d), N)


def q09_skew_factor(spark, d):
    both = [skew.skew_factor(skew.received_counts(_routed(spark, d, v), N)).withColumn("variant", F.lit(v)) for v in ("balanced", "skew")]
    return both[0].unionByName(both[1])


def q10_hot_cold(spark, d):
    return skew.hot_cold(skew.received_counts(_routed(spark, d), N))


def q11_ip_int_roundtrip(spark, d):
    ips = _tuples(spark, d).select("ip").distinct().withColumn("n", ip_to_int(F.col("ip")))
    return ips.withColumn("back", int_to_ip(F.col("n")))


def _sample_rows(spark, d):
    return _log(spark, d).select("site_id", "line_no", parse_ip(F.col("raw_line")).alias("ip"))


def q12_sample_bounds(spark, d):
    return partitioning.quantile_bounds(partitioning.sampled(_sample_rows(spark, d), SAMPLE), N)


def q13_range_rid_counts(spark, d):
    bounds = partitioning.fitted_bounds(_sample_rows(spark, d), N, SAMPLE)
    return skew.received_counts(partitioning.range_routed(dedup.local_distinct(_tuples(spark, d)), bounds), N)


def q14_equal_width_counts(spark, d):
    return skew.received_counts(partitioning.range_routed(dedup.local_distinct(_tuples(spark, d)), partitioning.equal_width_bounds(N)), N)


def q15_range_vs_hash_skew(spark, d):
    parts = {"hash": q07_rid_received_counts(spark, d), "range": q13_range_rid_counts(spark, d), "equal_width": q14_equal_width_counts(spark, d)}
    out = [skew.skew_factor(c).withColumn("strategy", F.lit(k)) for k, c in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def q16_chunk_hit_rates(spark, d):
    first = dedup.first_occurrences(log_tuples_with_lines(spark, d))
    return dedup.chunk_hit_rates(partitioning.hash_routed(first, N), 256, ("site_id", "line_no"))


def log_tuples_with_lines(spark, d):
    return _log(spark, d).select(parse_ip(F.col("raw_line")).alias("ip"), "site_id", "line_no").where("ip <> ''")


def q17_reducer_sites_compat(spark, d):
    return pipeline.partition_records(_routed(spark, d), compat_source_sites=True)


def q18_merge_last_wins(spark, d):
    # two runs with different partitions of the same addresses: the higher rid stays
    a = pipeline.partition_records(_routed(spark, d))
    b = pipeline.partition_records(partitioning.range_routed(dedup.local_distinct(_tuples(spark, d, "skew")), partitioning.equal_width_bounds(N)))
    return merge.merged(a.unionByName(b))


def _perturbed(ips: DataFrame) -> DataFrame:
    """Addresses without those whose number is a multiple of 97, and some that no line has."""
    n = ip_to_int(F.col("ip"))
    return ips.where(F.pmod(n, F.lit(97)) != 0).unionByName(ips.where(F.pmod(n, F.lit(89)) == 0).select(F.concat(F.lit("x"), F.col("ip")).alias("ip")))


def q19_missing_ips(spark, d):
    base = validate.baseline_ips(_log(spark, d))
    return validate.missing_ips(base, _perturbed(base))


def q20_extra_ips(spark, d):
    base = validate.baseline_ips(_log(spark, d))
    return validate.extra_ips(base, _perturbed(base))


def q21_validation_report(spark, d):
    base = validate.baseline_ips(_log(spark, d))
    good = validate.report(base, pipeline.store(_tuples(spark, d), SITES)).withColumn("input", F.lit("pipeline"))
    return good.unionByName(validate.report(base, _perturbed(base)).withColumn("input", F.lit("perturbed")))


def q22_top10_missing(spark, d):
    return validate.first_ips(q19_missing_ips(spark, d))


def q23_format_check(spark, d):
    return reports.format_check(_log(spark, d))


def q24_csv_source(spark, d):
    to = folder(spark, "csv")
    lines = _log(spark, d).select(F.concat(F.lit(" "), parse_ip(F.col("raw_line")), F.lit(" ")).alias("ip"), F.col("site_id").cast("string").alias("site"), F.concat(F.col("raw_line"), F.lit('\n"tail"')).alias("raw_line"))
    write_csv(lines, to)
    rows = csv_lines(spark, {1: to})
    return csv_tuples(rows).groupBy("ip").agg(F.count("*").alias("n")).join(rows.groupBy(F.trim("ip").alias("ip")).agg(F.max(F.length("raw_line")).cast("bigint").alias("longest")), "ip")


def q25_raw_export(spark, d):
    # numbering restarts for each site, without gathering a site in one task
    numbered = dedup.numbered_tuples(_log(spark, d).withColumn("rid", F.col("site_id")), ("line_no",))
    return numbered.select("site_id", F.col("rn").cast("bigint").alias("line_no"), "raw_line")


def q26_country_rollup(spark, d):
    return pipeline.store(_tuples(spark, d), SITES).groupBy("country").agg(F.count("*").alias("ips"), F.countDistinct("city").alias("cities"))


def _networks(spark: SparkSession) -> DataFrame:
    """A network for every second /6, one /8 inside and one /24 inside that."""
    wide = spark.range(0, 64, 2).select((F.col("id") * (1 << 26)).alias("lo"), ((F.col("id") + 1) * (1 << 26) - 1).alias("hi"), F.concat(F.lit("Land "), F.col("id")).alias("country"), F.lit("").alias("city"), F.col("id").cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    inner = spark.range(0, 256, 16).select((F.col("id") * (1 << 24)).alias("lo"), ((F.col("id") + 1) * (1 << 24) - 1).alias("hi"), F.lit("Inner").alias("country"), F.concat(F.lit("City "), F.col("id")).alias("city"), F.lit(1.5).alias("latitude"), F.lit(-2.5).alias("longitude"))
    return wide.unionByName(inner)


def q27_geo_range_join(spark, d):
    return geo.with_range_geo(_tuples(spark, d).select("ip").distinct(), _networks(spark))


def q28_embedded_ips(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"), F.lit(1))).alias("ip"))
    return found.groupBy("ip").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


def q29_sampling_skew(spark, d):
    bounds = partitioning.fitted_bounds(_sample_rows(spark, d), N, SAMPLE)
    drawn = partitioning.sampled(_sample_rows(spark, d), SAMPLE).select(partitioning.range_rid(F.col("ipn"), bounds).alias("rid"))
    return skew.skew_factor(skew.received_counts(drawn, N))


def q30_memory_estimate(spark, d):
    cases = spark.createDataFrame([(100.0, 550_000), (0.0, 0), (2048.5, 12_345_678)], "data_mb double, ips bigint")
    return cases.withColumns(memory_estimate(F.col("data_mb"), F.col("ips")))


_PHASES = [("extract", 0.75), ("reduce", 1.25), ("merge", 0.5)]
_TIMINGS = [(1, 4.0), (2, 2.5), (3, 1.5), (4, 1.5), (6, 1.75)]


def q31_latency_share(spark, d):
    return reports.latency_share(spark.createDataFrame(_PHASES, "phase string, seconds double"))


def q32_rebalance_counts(spark, d):
    start = partitioning.range_routed(dedup.local_distinct(_tuples(spark, d)), partitioning.equal_width_bounds(N))
    return skew.received_counts(rebalance.rebalanced(start, N)[0], N)


def q33_json_store_roundtrip(spark, d):
    to = folder(spark, "store")
    write_json_object(pipeline.store(_tuples(spark, d), SITES), to)
    return read_json_store(spark, to)


def q34_speedup_table(spark, d):
    return reports.speedup_table(spark.createDataFrame(_TIMINGS, "n int, seconds double"))


def q35_completed_partitions(spark, d):
    to = folder(spark, "parts")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for rid, text in ((0, "[]"), (2, ""), (3, "[1]")):
        p = fs.Path(f"{to}/reducer_{rid}.json")
        out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
        out.write(bytearray(text.encode()))
        out.close()
    return completed_partitions(spark, f"{to}/reducer_*.json", N)


def q36_stream_dedup(spark, d):
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(d, pathGlobFilter="events.parquet")
    to = folder(spark, "stream")
    query = distinct_tuples(events_log(stream)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start(f"{to}/out")
    query.awaitTermination()
    return spark.read.schema("ip string, site_id int").parquet(f"{to}/out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()} | file_catalog.queries()


# -- SQL ---------------------------------------------------------------------------

_CITY_ROWS = ", ".join(f"({i}, '{a}', '{b}', {round(x * 10_000)}, {round(y * 10_000)})" for i, (a, b, x, y) in enumerate(CITIES))

_BASE = rf"""
WITH ev AS (SELECT *, user_id * 10 + (event_id // 8) % 10 AS k FROM events),
evip AS (SELECT *, concat_ws('.', 1 + (k * 37) % 223, (k * 101) % 256, (k * 53) % 256, (k * 17) % 256) AS eip FROM ev),
log AS (SELECT CAST(1 + event_id % 4 AS INTEGER) AS site_id, event_id AS line_no, eip, eip || CASE WHEN event_id % 50 = 7 THEN ' broken' ELSE ' - - [01/Jan/2024:00:00:00 +0000] "GET /' || event_type || ' HTTP/1.1" 200 ' || (event_id % 1000) || ' "-" "agent"' END AS raw_line FROM evip),
slog AS (SELECT CAST(CASE WHEN event_id % 40 < 36 THEN 4 ELSE 1 + event_id % 3 END AS INTEGER) AS site_id, event_id AS line_no, eip FROM evip),
parsed AS (SELECT site_id, line_no, raw_line, regexp_extract(raw_line, '^([0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}})', 1) AS ip FROM log),
loc AS (SELECT DISTINCT ip, site_id FROM parsed WHERE ip <> ''),
sloc AS (SELECT DISTINCT eip AS ip, site_id FROM slog),
globs AS (SELECT ip, list_sort(list(site_id)) AS source_sites FROM loc GROUP BY ip),
num AS (SELECT ip, source_sites, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM globs),
fnv AS (SELECT ip, n, CAST(list_reduce(list_transform(range(1, length(ip) + 1), lambda i: CAST(ascii(substr(ip, i, 1)) AS UBIGINT)), lambda a, b: CAST((CAST(xor(a, b) AS HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS UBIGINT), 14695981039346656037::UBIGINT) % {N} AS INTEGER) AS rid FROM num),
cities(i, country, city, la, lo) AS (VALUES {_CITY_ROWS}),
geo AS (SELECT ip, n, source_sites, country, city, (la + (n // 52) % 1000) / 10000.0::DOUBLE AS latitude, (lo + (n // 52000) % 1000) / 10000.0::DOUBLE AS longitude FROM num JOIN cities ON i = n % 52),
rids AS (SELECT CAST(range AS INTEGER) AS rid FROM range({N})),
routed AS (SELECT loc.ip, site_id, rid, n FROM loc JOIN fnv USING (ip)),
received AS (SELECT rids.rid, count(ip) AS received FROM rids LEFT JOIN routed USING (rid) GROUP BY rids.rid),
ewroute AS (SELECT loc.ip, site_id, CAST(n // 1073741824 AS INTEGER) AS rid FROM loc JOIN num USING (ip)),
ew AS (SELECT rids.rid, count(ip) AS received FROM rids LEFT JOIN ewroute USING (rid) GROUP BY rids.rid),
drawn AS (SELECT n FROM (SELECT md5(parsed.ip || '|' || line_no || '|' || site_id) AS k, n FROM parsed JOIN num USING (ip) ORDER BY k, n LIMIT {SAMPLE})),
vals AS (SELECT list_sort(list(n)) AS v FROM drawn),
bounds AS (SELECT [0, {", ".join(f"v[len(v) * {i} // {N} + 1]" for i in range(1, N))}, 4294967296] AS bounds FROM vals),
rroute AS (SELECT loc.ip, CAST({" + ".join(f"(n >= bounds[{i + 1}])::INTEGER" for i in range(1, N))} AS INTEGER) AS rid FROM loc JOIN num USING (ip), bounds),
ranged AS (SELECT rids.rid, count(ip) AS received FROM rids LEFT JOIN rroute USING (rid) GROUP BY rids.rid),
pert AS (SELECT ip FROM num WHERE n % 97 <> 0 UNION ALL SELECT 'x' || ip FROM num WHERE n % 89 = 0)
"""


def _skew_sql(counts: str) -> str:
    return f"SELECT skew, CASE WHEN skew > 0.5 THEN 'high' WHEN skew > 0.2 THEN 'moderate' ELSE 'low' END AS level FROM (SELECT round((max(received) - min(received)) / avg(received), 6) AS skew FROM {counts})"


#: The counts after each move, as one list, until the skew is at most 0.5, the fullest is within one of the mean, or ten are made.
_REBALANCE_SQL = f""", moved AS (
SELECT 0 AS step, list(received ORDER BY rid) AS c FROM ew UNION ALL
SELECT step + 1, list_transform(range(1, {N + 1}), lambda i: CASE WHEN i = hot THEN c[i] - k WHEN i = cold THEN c[i] + k ELSE c[i] END) FROM (
SELECT *, (high - mean) // 2 AS k FROM (
SELECT step, c, list_max(c) AS high, list_min(c) AS low, list_sum(c)::BIGINT // {N} AS mean, list_sum(c)::BIGINT AS total, list_position(c, list_max(c)) AS hot, list_position(c, list_min(c)) AS cold FROM moved))
WHERE step < 10 AND (high - low) * {N} > 0.5 * total AND high > mean + 1 AND k > 0)
SELECT CAST(i - 1 AS INTEGER) AS rid, c[i] AS received FROM (SELECT c FROM moved ORDER BY step DESC LIMIT 1), range(1, {N + 1}) AS r(i)"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "q01_geo_store": "SELECT ip, country, city, latitude, longitude, source_sites FROM geo",
        "q02_parse_ip": "SELECT site_id, count(*) FILTER (ip <> '') AS matched, count(*) AS total FROM parsed GROUP BY site_id",
        "q03_local_distinct": "SELECT site_id, count(*) AS n FROM loc GROUP BY site_id",
        "q04_global_distinct": "SELECT ip, source_sites FROM globs",
        "q05_pipeline_counts": "SELECT (SELECT count(*) FROM log) AS rows_read, (SELECT count(*) FROM loc) AS ip_local, (SELECT count(*) FROM globs) AS ip_global, (SELECT count(*) FROM loc) - (SELECT count(*) FROM globs) AS skipped",
        "q06_fnv_rid": "SELECT ip, rid FROM fnv",
        "q07_rid_received_counts": "SELECT rid, received FROM received",
        "q08_rid_unique_share": "SELECT rids.rid, count(ip) AS uniques, round(count(ip) * 100.0::DOUBLE / sum(count(ip)) OVER (), 4) AS share FROM rids LEFT JOIN fnv USING (rid) GROUP BY rids.rid",
        "q09_skew_factor": f"""SELECT *, 'balanced' AS variant FROM ({_skew_sql("received")}) UNION ALL
SELECT *, 'skew' AS variant FROM ({_skew_sql("(SELECT rids.rid, count(ip) AS received FROM rids LEFT JOIN (SELECT sloc.ip, rid FROM sloc JOIN fnv USING (ip)) USING (rid) GROUP BY rids.rid)")})""",
        "q10_hot_cold": "SELECT (SELECT rid FROM received ORDER BY received DESC, rid LIMIT 1) AS hot, max(received) AS hot_count, (SELECT rid FROM received ORDER BY received, rid LIMIT 1) AS cold, min(received) AS cold_count FROM received",
        "q11_ip_int_roundtrip": "SELECT ip, n, ip AS back FROM num",
        "q12_sample_bounds": "SELECT bounds FROM bounds",
        "q13_range_rid_counts": "SELECT rid, received FROM ranged",
        "q14_equal_width_counts": "SELECT rid, received FROM ew",
        "q15_range_vs_hash_skew": " UNION ALL ".join(f"SELECT *, '{k}' AS strategy FROM ({_skew_sql(t)})" for k, t in (("hash", "received"), ("range", "ranged"), ("equal_width", "ew"))),
        "q16_chunk_hit_rates": """SELECT rid, chunk_id, received, local_dup, global_dup, round(global_dup / received, 4) AS hit_rate FROM (
SELECT rid, (rn - 1) // 256 AS chunk_id, count(*) AS received, count(*) FILTER (l > 1) AS local_dup, count(*) FILTER (g > 1) AS global_dup FROM (
SELECT *, row_number() OVER (PARTITION BY rid, ip ORDER BY rn) AS g, row_number() OVER (PARTITION BY rid, ip, (rn - 1) // 256 ORDER BY rn) AS l FROM (
SELECT ip, rid, row_number() OVER (PARTITION BY rid ORDER BY site_id, line_no) AS rn FROM (SELECT ip, site_id, min(line_no) AS line_no FROM parsed WHERE ip <> '' GROUP BY ip, site_id) JOIN fnv USING (ip))) GROUP BY rid, (rn - 1) // 256)""",
        "q17_reducer_sites_compat": "SELECT rid, geo.ip, country, city, latitude, longitude, sites AS source_sites FROM geo JOIN fnv USING (ip) JOIN (SELECT rid, list_sort(list(DISTINCT site_id)) AS sites FROM routed GROUP BY rid) USING (rid)",
        "q18_merge_last_wins": """SELECT geo.ip, country, city, latitude, longitude, s AS source_sites FROM geo JOIN (
SELECT ip, s, row_number() OVER (PARTITION BY ip ORDER BY rid DESC, s DESC) AS rn FROM (
SELECT rid, globs.ip, source_sites AS s FROM globs JOIN fnv USING (ip) UNION ALL
SELECT CAST(n // 1073741824 AS INTEGER) AS rid, num.ip, t AS s FROM num JOIN (SELECT ip, list_sort(list(site_id)) AS t FROM sloc GROUP BY ip) USING (ip))) USING (ip) WHERE rn = 1""",
        "q19_missing_ips": "SELECT ip FROM globs WHERE ip NOT IN (SELECT ip FROM pert)",
        "q20_extra_ips": "SELECT ip FROM pert WHERE ip NOT IN (SELECT ip FROM globs)",
        "q21_validation_report": """SELECT count(*) AS baseline_count, count(*) AS pipeline_count, 0::BIGINT AS missing, 0::BIGINT AS extra, count(*) > 0 AS passed, 'pipeline' AS input FROM globs UNION ALL
SELECT a, b, m, e, m = 0 AND e = 0 AND a > 0, 'perturbed' FROM (SELECT (SELECT count(*) FROM globs) AS a, (SELECT count(*) FROM pert) AS b, (SELECT count(*) FROM globs WHERE ip NOT IN (SELECT ip FROM pert)) AS m, (SELECT count(*) FROM pert WHERE ip NOT IN (SELECT ip FROM globs)) AS e)""",
        "q22_top10_missing": "SELECT ip FROM globs WHERE ip NOT IN (SELECT ip FROM pert) ORDER BY ip LIMIT 10",
        "q23_format_check": "SELECT site_id, count(*) FILTER (line_no % 50 <> 7) AS matched, count(*) AS total, round(count(*) FILTER (line_no % 50 <> 7) / count(*), 6) AS ratio FROM log GROUP BY site_id",
        "q24_csv_source": "SELECT ip, count(*) AS n, max(length(raw_line)) + 7 AS longest FROM parsed GROUP BY ip",
        "q25_raw_export": "SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY line_no) AS line_no, raw_line FROM log",
        "q26_country_rollup": "SELECT country, count(*) AS ips, count(DISTINCT city) AS cities FROM geo GROUP BY country",
        "q27_geo_range_join": """SELECT ip, CASE WHEN (n // 16777216) % 16 = 0 THEN 'Inner' WHEN (n // 67108864) % 2 = 0 THEN 'Land ' || (n // 67108864) ELSE country END AS country,
CASE WHEN (n // 16777216) % 16 = 0 THEN 'City ' || (n // 16777216) WHEN (n // 67108864) % 2 = 0 THEN 'Unknown' ELSE city END AS city,
CASE WHEN (n // 16777216) % 16 = 0 THEN 1.5::DOUBLE WHEN (n // 67108864) % 2 = 0 THEN (n // 67108864)::DOUBLE ELSE latitude END AS latitude,
CASE WHEN (n // 16777216) % 16 = 0 THEN -2.5::DOUBLE WHEN (n // 67108864) % 2 = 0 THEN 0.0::DOUBLE ELSE longitude END AS longitude FROM geo""",
        "q28_embedded_ips": "SELECT ip, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')) AS ip FROM documents) GROUP BY ip",
        "q29_sampling_skew": _skew_sql(f"(SELECT rids.rid, count(r) AS received FROM rids LEFT JOIN (SELECT CAST({' + '.join(f'(n >= bounds[{i + 1}])::INTEGER' for i in range(1, N))} AS INTEGER) AS r FROM drawn, bounds) ON r = rids.rid GROUP BY rids.rid)"),
        "q30_memory_estimate": """SELECT data_mb, ips, round(data_mb * 1.5, 2) AS log_buffer_mb, 60.0::DOUBLE AS geo_db_mb, round(ips * 80 / 1048576.0::DOUBLE, 2) AS ip_set_mb, round(ips * 200 / 1048576.0::DOUBLE, 2) AS result_json_mb, 50.0::DOUBLE AS overhead_mb,
round(data_mb * 1.5 + 60 + ips * 80 / 1048576.0::DOUBLE + ips * 200 / 1048576.0::DOUBLE + 50, 2) AS total_mb FROM (VALUES (100.0::DOUBLE, 550000::BIGINT), (0.0, 0), (2048.5, 12345678)) AS t(data_mb, ips)""",
        "q31_latency_share": f"SELECT phase, seconds, round(seconds * 100 / sum(seconds) OVER (), 4) AS percent, seconds = max(seconds) OVER () AS bottleneck FROM (VALUES {', '.join(f'({p!r}, {s}::DOUBLE)' for p, s in _PHASES)}) AS t(phase, seconds)",
        "q33_json_store_roundtrip": "SELECT ip, country, city, latitude, longitude, source_sites FROM geo",
        "q34_speedup_table": f"SELECT n, seconds, round(first_value(seconds) OVER (ORDER BY n) / seconds, 6) AS speedup, round(first_value(seconds) OVER (ORDER BY n) / seconds / n * 100, 6) AS efficiency FROM (VALUES {', '.join(f'({n}::INTEGER, {s}::DOUBLE)' for n, s in _TIMINGS)}) AS t(n, seconds)",
        "q36_stream_dedup": "SELECT ip, site_id FROM loc",
    }
    out = {k: _BASE + v for k, v in (sql | file_catalog.sql()).items()}
    out["q32_rebalance_counts"] = _BASE.replace("WITH", "WITH RECURSIVE", 1) + _REBALANCE_SQL
    out["q35_completed_partitions"] = f"SELECT CAST(range AS INTEGER) AS rid, range IN (0, 3) AS done FROM range({N})"
    return out
