"""How evenly partitions are filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _all(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("rid"))


def received_counts(routed: DataFrame, n: int) -> DataFrame:
    """rid, received for every partition; those without tuples count 0."""
    counts = routed.groupBy("rid").agg(F.count("*").alias("received"))
    return _all(routed, n).join(counts, "rid", "left").select("rid", F.coalesce("received", F.lit(0)).alias("received"))


def unique_share(routed: DataFrame, n: int) -> DataFrame:
    """rid, uniques (distinct addresses) and their percentage of all partitions' uniques."""
    counts = routed.select("rid", "ip").distinct().groupBy("rid").agg(F.count("*").alias("uniques"))
    all_ = _all(routed, n).join(counts, "rid", "left").select("rid", F.coalesce("uniques", F.lit(0)).alias("uniques"))
    return all_.withColumn("share", F.round(F.try_divide(F.col("uniques") * 100.0, F.sum("uniques").over(Window.partitionBy())), 4))


def skew_factor(counts: DataFrame, column: str = "received", threshold: float = 0.5) -> DataFrame:
    """One row: skew = (most - least) / mean, 0 for empty input, and its level high (above threshold), moderate (above 0.2) or low."""
    c = F.col(column)
    skew = F.coalesce(F.try_divide((F.max(c) - F.min(c)).cast("double"), F.avg(c)), F.lit(0.0))
    return counts.agg(F.round(skew, 6).alias("skew")).withColumn("level", F.when(F.col("skew") > threshold, "high").when(F.col("skew") > 0.2, "moderate").otherwise("low"))


def hot_cold(counts: DataFrame, column: str = "received") -> DataFrame:
    """One row: the fullest and the emptiest partition, the lower rid on ties, and their counts."""
    c = F.col(column)
    return counts.agg(F.max_by("rid", F.struct(c, -F.col("rid"))).alias("hot"), F.max(c).alias("hot_count"), F.min_by("rid", F.struct(c, F.col("rid"))).alias("cold"), F.min(c).alias("cold_count"))
