"""Registered queries that write files, read them back through the sources, and run the pipeline over them.

Their SQL is that of the same rows without any file: parsing, routing, merging
and the stores' formats all have to agree with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SITES, Dataset, PipelineConfig
from ..functions import parse_ip, sample_ip
from ..operators import dedup, geo, merge, partitioning, validate
from ..scratch import folder
from ..sinks import clean_orphans, write_csv, write_partitions
from ..sources import events_log, failed_partitions, log_lines, numbered_lines, opened, read_intermediate, read_json_store
from . import pipeline

N = 4


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.local_distinct(_log(spark, sf_dir).select(parse_ip(F.col("raw_line")).alias("ip"), "site_id").where("ip <> ''"))


def text_logs(spark: SparkSession, sf_dir: str) -> dict[int, str]:
    """One folder of text files for each site; their files bear the same names."""
    to = folder(spark, "logs")
    _log(spark, sf_dir).select("site_id", "raw_line").write.partitionBy("site_id").text(to)
    return {i: f"{to}/site_id={i}" for i in SITES}


def csv_logs(spark: SparkSession, sf_dir: str) -> Dataset:
    """The same lines as CSV records, a folder for each site, and all of them as the unified file."""
    to = folder(spark, "csv")
    rows = _log(spark, sf_dir).select(F.concat(F.lit(" "), parse_ip(F.col("raw_line"))).alias("ip"), F.col("site_id").cast("string").alias("site"), "raw_line", "site_id")
    rows.write.partitionBy("site_id").options(header=True, quote='"', escape='"').csv(f"{to}/sites")
    write_csv(rows.drop("site_id"), f"{to}/unified")
    return Dataset("csv", {i: f"{to}/sites/site_id={i}" for i in SITES}, f"{to}/unified")


def _file(spark: SparkSession, path: str, text: str = "") -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode()))
    out.close()


def _one_file(lines: DataFrame, path: str) -> None:
    """A single text file of a small table, for readers that go by file names."""
    spark = lines.sparkSession
    lines.coalesce(1).write.text(f"{path}.d")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}.d/part-*")
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.rename(store.globStatus(p)[0].getPath(), jvm.org.apache.hadoop.fs.Path(path))


def _names(spark: SparkSession, pattern: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or ())


# -- queries -----------------------------------------------------------------------


def q37_text_log_scan(spark, d):
    return validate.site_matches(log_lines(spark, text_logs(spark, d) | {9: f"{d}/no-such-file.log"}))


def q38_file_run_hash(spark, d):
    to = folder(spark, "run")
    pipeline.run(spark, Dataset("log", text_logs(spark, d)), to, PipelineConfig(n_reducers=N))
    return spark.read.parquet(f"{to}/store")


def q39_file_run_range(spark, d):
    to = folder(spark, "run")
    pipeline.run(spark, csv_logs(spark, d), to, PipelineConfig(n_reducers=N, strategy="range", sample_size=1000))
    return spark.read.parquet(f"{to}/store")


def q40_file_run_figures(spark, d):
    rows = []
    for name, dataset in (("text", Dataset("log", text_logs(spark, d))), ("csv", csv_logs(spark, d))):
        found = pipeline.run(spark, dataset, folder(spark, "run"), PipelineConfig(n_reducers=3))
        rows.append((name, found["rows_read"], found["ip_local"], found["ip_global"], found["skipped"]))
    return spark.createDataFrame(rows, "source string, rows_read bigint, ip_local bigint, ip_global bigint, skipped bigint")


def q41_validated_runs(spark, d):
    out = None
    for name, dataset in (("text", Dataset("log", text_logs(spark, d))), ("csv", csv_logs(spark, d))):
        to = folder(spark, "run")
        pipeline.run(spark, dataset, to)
        found = pipeline.validated(spark, dataset, to).withColumn("source", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def q42_intermediate_merge(spark, d):
    to = folder(spark, "parts")
    records = pipeline.partition_records(partitioning.hash_routed(_local(spark, d), N))
    arrays = records.groupBy("rid").agg(F.to_json(F.collect_list(F.struct(*[c for c in records.columns if c != "rid"]))).alias("value"))
    for k in range(N):
        _one_file(arrays.where(F.col("rid") == k).select("value"), f"{to}/reducer_{k}.json")
    _file(spark, f"{to}/reducer_{N}.json")
    _file(spark, f"{to}/reducer_{N + 1}.json", '[{"ip": "9.9.9.9", ')
    return merge.merged(read_intermediate(spark, [f"{to}/reducer_{k}.json" for k in range(N + 3)]))


def q43_numbered_files(spark, d):
    to = folder(spark, "raw")
    for i, name in SITES.items():
        _one_file(_log(spark, d).where(F.col("site_id") == i).repartition(1).sortWithinPartitions("line_no").select("raw_line"), f"{to}/{name}_access.log")
    return numbered_lines(spark, [f"{to}/{name}_access.log" for name in SITES.values()])


def q44_orphans_cleaned(spark, d):
    to = folder(spark, "orphans")
    for name in ("reducer_0.json", "reducer_1.json", "reducer_2.tmp", "central_store.json"):
        _file(spark, f"{to}/{name}", "[]")
    n = clean_orphans(spark, to)
    return spark.createDataFrame([(n, ",".join(_names(spark, f"{to}/*")))], "cleaned bigint, kept string")


def q45_list_store(spark, d):
    to = folder(spark, "list")
    records = pipeline.store(_local(spark, d), SITES)
    nameless = records.limit(3).withColumn("ip", F.lit(""))
    whole = records.unionByName(nameless).agg(F.to_json(F.collect_list(F.struct(*records.columns))).alias("value"))
    whole.coalesce(1).write.text(to)
    return read_json_store(spark, to)


def q46_networks_from_file(spark, d):
    to = f"{folder(spark, 'networks')}/networks.csv"
    wide = spark.range(0, 64, 2).select(F.concat(F.col("id") * 4, F.lit(".0.0.0/6")).alias("network"), F.concat(F.lit("Land "), F.col("id")).alias("country"), F.lit(None).cast("string").alias("city"), F.col("id").cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    inner = spark.range(0, 256, 16).select(F.concat(F.col("id"), F.lit(".0.0.0/8")).alias("network"), F.lit("Inner").alias("country"), F.concat(F.lit("City "), F.col("id")).alias("city"), F.lit(1.5).alias("latitude"), F.lit(-2.5).alias("longitude"))
    broken = spark.createDataFrame([("300.0.0.0/8", "Bad", "Bad", 0.0, 0.0), ("1.2.3.4", "Bad", "Bad", 0.0, 0.0)], wide.schema)
    write_csv(wide.unionByName(inner).unionByName(broken), to)
    ips = _local(spark, d).select("ip").distinct().unionByName(spark.createDataFrame([(x,) for x in NO_ADDRESSES], "ip string"))
    return geo.located(ips, opened(spark, to))


NO_ADDRESSES = ("abc", "1.2.3", "999.1.2.3")


def q47_chunk_summary(spark, d):
    rows = _log(spark, d).select(parse_ip(F.col("raw_line")).alias("ip"), "site_id", "line_no").where("ip <> ''")
    routed = partitioning.range_routed(dedup.first_occurrences(rows), partitioning.equal_width_bounds(16))
    return dedup.chunk_summary(dedup.chunk_hit_rates(routed, 64, ("site_id", "line_no"), 16))


def q48_count_check(spark, d):
    base = _local(spark, d)
    same = validate.count_check(base, pipeline.store(base, SITES)).withColumn("input", F.lit("pipeline"))
    return same.unionByName(validate.count_check(base, base.where("site_id = 1")).withColumn("input", F.lit("one site")))


def q49_failed_partitions(spark, d):
    to = folder(spark, "parts")
    for rid, text in ((0, "[]"), (2, ""), (3, "[1]")):
        _file(spark, f"{to}/reducer_{rid}.json", text)
    return failed_partitions(spark, f"{to}/reducer_*.json", N)


def q50_recovered_partitions(spark, d):
    to = folder(spark, "run")
    local = partitioning.hash_routed(_local(spark, d), N)
    write_partitions(pipeline.partition_records(local.where("rid <> 1")), f"{to}/intermediate")
    pipeline.recovered(spark, local, to, PipelineConfig(n_reducers=N))
    return spark.read.parquet(f"{to}/store")


def q51_boundary_report(spark, d):
    rows = _log(spark, d).select("site_id", "line_no", parse_ip(F.col("raw_line")).alias("ip"))
    return spark.createDataFrame([(partitioning.boundary_report(partitioning.fitted_bounds(rows, N, 2000)),)], "report string")


def q52_grouped_ips(spark, d):
    return partitioning.grouped_ips(partitioning.hash_routed(_local(spark, d).select("ip").distinct(), N))


def q53_sampler_lines(spark, d):
    lines = log_lines(spark, text_logs(spark, d))
    return lines.where(sample_ip(F.col("raw_line")) != "").groupBy("site_id").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}


# -- SQL ---------------------------------------------------------------------------

_STORE = "SELECT ip, country, city, latitude, longitude, source_sites FROM geo"
_COUNTS = "(SELECT count(*) FROM log) AS rows_read, (SELECT count(*) FROM loc) AS ip_local, (SELECT count(*) FROM globs) AS ip_global, (SELECT count(*) FROM loc) - (SELECT count(*) FROM globs) AS skipped"
_SAME = "count(*) AS baseline_count, count(*) AS pipeline_count, 0::BIGINT AS missing, 0::BIGINT AS extra, count(*) > 0 AS passed"
_SITE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in SITES.items())
_LISTED = ", ".join(f"('{x}')" for x in NO_ADDRESSES)


def sql() -> dict[str, str]:
    """DuckDB SQL after the common tables of ``catalog``."""
    return {
        "q37_text_log_scan": "SELECT site_id, count(*) FILTER (ip <> '') AS matched, count(*) AS total FROM parsed GROUP BY site_id",
        "q38_file_run_hash": _STORE,
        "q39_file_run_range": _STORE,
        "q40_file_run_figures": f"SELECT 'text' AS source, {_COUNTS} UNION ALL SELECT 'csv' AS source, {_COUNTS}",
        "q41_validated_runs": f"SELECT {_SAME}, 'text' AS source FROM globs UNION ALL SELECT {_SAME}, 'csv' AS source FROM globs",
        "q42_intermediate_merge": _STORE,
        "q43_numbered_files": f"SELECT CASE site_id {_SITE} END AS site, CASE site_id {_SITE} END || '_access.log' AS file, row_number() OVER (PARTITION BY site_id ORDER BY line_no) AS line_no, raw_line FROM log",
        "q44_orphans_cleaned": "SELECT 2::BIGINT AS cleaned, 'central_store.json' AS kept",
        "q45_list_store": _STORE,
        "q46_networks_from_file": f"""SELECT ip, CASE WHEN (n // 16777216) % 16 = 0 THEN 'Inner' WHEN (n // 67108864) % 2 = 0 THEN 'Land ' || (n // 67108864) ELSE country END AS country,
CASE WHEN (n // 16777216) % 16 = 0 THEN 'City ' || (n // 16777216) WHEN (n // 67108864) % 2 = 0 THEN 'Unknown' ELSE city END AS city,
CASE WHEN (n // 16777216) % 16 = 0 THEN 1.5::DOUBLE WHEN (n // 67108864) % 2 = 0 THEN (n // 67108864)::DOUBLE ELSE latitude END AS latitude,
CASE WHEN (n // 16777216) % 16 = 0 THEN -2.5::DOUBLE WHEN (n // 67108864) % 2 = 0 THEN 0.0::DOUBLE ELSE longitude END AS longitude FROM geo
UNION ALL SELECT ip, country, city, (la + (m // 52) % 1000) / 10000.0::DOUBLE, (lo + (m // 52000) % 1000) / 10000.0::DOUBLE FROM (
SELECT ip, CASE WHEN ip LIKE '%.%.%.%' THEN CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT)
ELSE CAST(list_reduce(list_transform(range(1, length(ip) + 1), lambda i: CAST(ascii(substr(ip, i, 1)) AS UBIGINT)), lambda a, b: CAST((CAST(xor(a, b) AS HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT AS UBIGINT), 14695981039346656037::UBIGINT) // 4294967296::UBIGINT AS BIGINT) END AS m
FROM (VALUES {_LISTED}) AS v(ip)) JOIN cities ON i = m % 52""",
        "q47_chunk_summary": """SELECT CAST(r.range AS INTEGER) AS rid, greatest(count(h), 1) AS n_chunks, coalesce(round((sum(CAST(round(h * 10000) AS BIGINT)) / count(h)) / 10000, 6), 0.0) AS avg_hit_rate, coalesce(max(h), 0.0) AS max_hit_rate FROM range(16) AS r LEFT JOIN (
SELECT rid, round(count(*) FILTER (g > 1) / count(*), 4) AS h FROM (
SELECT *, row_number() OVER (PARTITION BY rid, ip ORDER BY rn) AS g FROM (
SELECT x.ip, CAST(n // 268435456 AS INTEGER) AS rid, row_number() OVER (PARTITION BY n // 268435456 ORDER BY site_id, line_no) AS rn FROM (SELECT ip, site_id, min(line_no) AS line_no FROM parsed WHERE ip <> '' GROUP BY ip, site_id) x JOIN num USING (ip))) GROUP BY rid, (rn - 1) // 64) ON rid = r.range GROUP BY r.range""",
        "q48_count_check": "SELECT count(*) AS baseline_count, count(*) AS pipeline_count, true AS passed, 'pipeline' AS input FROM globs UNION ALL SELECT a, b, a = b, 'one site' FROM (SELECT (SELECT count(*) FROM globs) AS a, (SELECT count(*) FROM loc WHERE site_id = 1) AS b)",
        "q49_failed_partitions": "SELECT rid FROM rids WHERE rid IN (1, 2)",
        "q50_recovered_partitions": _STORE,
        "q51_boundary_report": f"SELECT string_agg('R' || (i - 1) || ':' || (bounds[i] % 256) || '-' || ((bounds[i + 1] - 1) % 256), ' | ' ORDER BY i) AS report FROM bounds, range(1, {N + 1}) AS r(i)",
        "q52_grouped_ips": "SELECT rid, list_sort(list(ip)) AS ips FROM fnv GROUP BY rid",
        "q53_sampler_lines": "SELECT site_id, count(*) AS n FROM parsed WHERE ip <> '' AND (contains(raw_line, '\"') OR contains(raw_line, ' - - [')) GROUP BY site_id",
    }
