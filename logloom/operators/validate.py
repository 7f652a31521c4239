"""Comparison of the pipeline's addresses with those of a baseline that is computed on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import parse_ip


def baseline_ips(lines: DataFrame) -> DataFrame:
    """Distinct addresses at the start of raw_line, be it a log line or a CSV record's last field."""
    return lines.select(parse_ip(F.col("raw_line")).alias("ip")).where("ip <> ''").distinct()


def site_matches(lines: DataFrame) -> DataFrame:
    """site_id, matched, total lines."""
    hit = parse_ip(F.col("raw_line")) != ""
    return lines.groupBy("site_id").agg(F.count_if(hit).alias("matched"), F.count("*").alias("total"))


def missing_ips(baseline: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Addresses of the baseline that the pipeline lacks."""
    return baseline.select("ip").distinct().join(pipeline.select("ip"), "ip", "left_anti")


def extra_ips(baseline: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Addresses of the pipeline that the baseline lacks."""
    return missing_ips(pipeline, baseline)


def first_ips(ips: DataFrame, k: int = 10) -> DataFrame:
    """The first k addresses as text; no full sort."""
    return ips.select("ip").orderBy("ip").limit(k)


def count_check(baseline: DataFrame, pipeline: DataFrame) -> DataFrame:
    """One row: baseline_count, pipeline_count, passed if they are equal; cheaper and weaker than ``report``."""
    b, p = (x.agg(F.countDistinct("ip").alias(f"{n}_count")) for x, n in ((baseline, "baseline"), (pipeline, "pipeline")))
    return b.join(p).withColumn("passed", F.col("baseline_count") == F.col("pipeline_count"))


def report(baseline: DataFrame, pipeline: DataFrame, allow_empty: bool = False) -> DataFrame:
    """One row: baseline_count, pipeline_count, missing, extra, passed, by one full outer join.

    Passed needs equal sets, and rows unless allow_empty.
    """
    b = baseline.select("ip").distinct().withColumn("b", F.lit(1))
    p = pipeline.select("ip").distinct().withColumn("p", F.lit(1))
    counts = b.join(p, "ip", "full_outer").agg(F.count("b").alias("baseline_count"), F.count("p").alias("pipeline_count"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"))
    same = (F.col("missing") == 0) & (F.col("extra") == 0)
    return counts.withColumn("passed", same if allow_empty else same & (F.col("baseline_count") > 0))
