"""Access logs and their CSV form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Dataset
from ..functions.net import parse_ip, sample_ip

LOG_SCHEMA = "site_id int, line_no bigint, raw_line string"
CSV_SCHEMA = "ip string, site string, raw_line string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any path of a glob, is there, in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def log_lines(spark: SparkSession, files: Mapping[int, str]) -> DataFrame:
    """site_id, raw_line of all sites' text logs.  Files that aren't there count as empty.

    A site's path may be a file, a folder or a glob; sites are told apart by
    their paths, so equal file names in different folders don't mix.
    """
    parts = [spark.read.text(p).select(F.lit(i).cast("int").alias("site_id"), F.col("value").alias("raw_line")) for i, p in files.items() if exists(spark, p)]
    return _union(parts) if parts else spark.createDataFrame([], "site_id int, raw_line string")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def csv_lines(spark: SparkSession, files: Mapping[int, str]) -> DataFrame:
    """site_id, ip, raw_line of all sites' CSV files; doubled quotes and line breaks inside quotes are understood.

    As a quoted field may hold line breaks, a file can't be split: one task reads
    one file, so large exports should come in many files.  Fields go by the header's names: a file without an ip column gives null ips.
    """
    found = {i: p for i, p in files.items() if exists(spark, p)}
    parts = []
    for site, path in found.items():
        read = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
        have = {c: c for c in read.columns}
        parts.append(read.select(F.lit(site).alias("site_id"), *[(F.col(have[c]) if c in have else F.lit(None)).cast("string").alias(c) for c in ("ip", "raw_line")]))
    return _union(parts) if parts else spark.createDataFrame([], "site_id int, ip string, raw_line string")


def log_tuples(lines: DataFrame) -> DataFrame:
    """ip, site_id of every line that begins with an address; not yet distinct."""
    return lines.select(parse_ip(F.col("raw_line")).alias("ip"), "site_id").where("ip <> ''")


def csv_tuples(rows: DataFrame) -> DataFrame:
    """ip, site_id of every record whose trimmed ip isn't empty; the ip isn't checked otherwise."""
    return rows.select(F.trim("ip").alias("ip"), "site_id").where("ip <> ''")


def dataset_rows(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """ip ('' if none), site_id and sampled, the address that the sampler reads ('' if none), of every line or record.

    A site's file counts as CSV if the dataset does or its name ends in .csv.
    """
    csv = {i: p for i, p in dataset.files.items() if dataset.kind == "csv" or p.endswith(".csv")}
    logs = {i: p for i, p in dataset.files.items() if i not in csv}
    raw = F.col("raw_line")
    parts = []
    if logs:
        parts.append(log_lines(spark, logs).select(parse_ip(raw).alias("ip"), "site_id", sample_ip(raw).alias("sampled")))
    if csv:
        parts.append(csv_lines(spark, csv).select(F.coalesce(F.trim("ip"), F.lit("")).alias("ip"), "site_id", F.coalesce(sample_ip(raw), F.lit("")).alias("sampled")))
    return _union(parts) if parts else spark.createDataFrame([], "ip string, site_id int, sampled string")


def dataset_tuples(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """ip, site_id of a dataset's lines and records that have an address; not yet distinct."""
    return dataset_rows(spark, dataset).where("ip <> ''").select("ip", "site_id")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """site, file, line_no (from 1 in each file), raw_line of text logs.

    Lines are numbered by two narrow passes over the same splits, which together
    keep files' order: one counts each partition's lines of a file, the other
    adds a running number to the counts before it.  Nothing is sorted.  Files go
    by their paths; ``file`` is the name alone.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw_line"), F.monotonically_increasing_id().alias("id"))
    before = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))

    w = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = before.select("path", "block", "first_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    site = F.regexp_replace(F.regexp_replace("file", r"\.[^.]*$", ""), "_access", "")
    return lines.join(starts, ["path", "block"]).select(site.alias("site"), "file", (F.col("before") + F.col("id") - F.col("first_id") + 1).alias("line_no"), "raw_line")


def events_log(events: DataFrame, variant: str = "balanced") -> DataFrame:
    """An access log derived from an events table by whole-number arithmetic: site_id, line_no, raw_line.

    variant: "balanced" over four sites, or "skew" with nine tenths at site 4.
    One line in fifty isn't in the Combined Log Format, but begins with its address.
    """
    e = F.col("event_id")
    k = F.col("user_id") * 10 + F.pmod(F.expr("event_id div 8"), F.lit(10))
    ip = F.concat_ws(".", (1 + F.pmod(k * 37, F.lit(223))).cast("string"), *[F.pmod(k * m, F.lit(256)).cast("string") for m in (101, 53, 17)])
    if variant == "skew":
        site = F.when(F.pmod(e, F.lit(40)) < 36, F.lit(4)).otherwise(1 + F.pmod(e, F.lit(3)))
    else:
        site = 1 + F.pmod(e, F.lit(4))
    good = F.concat(ip, F.lit(' - - [01/Jan/2024:00:00:00 +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" 200 '), F.pmod(e, F.lit(1000)).cast("string"), F.lit(' "-" "agent"'))
    line = F.when(F.pmod(e, F.lit(50)) == 7, F.concat(ip, F.lit(" broken"))).otherwise(good)
    return events.select(site.cast("int").alias("site_id"), e.alias("line_no"), line.alias("raw_line"))
