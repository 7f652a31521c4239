"""Format checks and tables of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import is_combined
from ..functions.numeric import share


def format_check(lines: DataFrame, by: str = "site_id") -> DataFrame:
    """Per file or site: lines in the Combined Log Format, all lines, and the ratio (null without lines)."""
    ok = is_combined(F.col("raw_line"))
    counts = lines.groupBy(by).agg(F.count_if(ok).alias("matched"), F.count("*").alias("total"))
    return counts.withColumn("ratio", F.round(F.try_divide(F.col("matched").cast("double"), F.col("total")), 6))


def latency_share(phases: DataFrame) -> DataFrame:
    """phase, seconds, percent of the total and whether it is the longest; phases number at most a few."""
    longest = F.max(F.struct("seconds", "phase")).over(Window.partitionBy())
    return phases.select("phase", "seconds", F.round(share(F.col("seconds")), 4).alias("percent"), (F.col("phase") == longest["phase"]).alias("bottleneck"))


def speedup_table(timings: DataFrame) -> DataFrame:
    """n, seconds, speedup against the run with the least n, and efficiency in percent."""
    base = F.first_value("seconds").over(Window.partitionBy().orderBy("n"))
    speedup = F.try_divide(base, F.col("seconds"))
    return timings.select("n", "seconds", F.round(speedup, 6).alias("speedup"), F.round(speedup / F.col("n") * 100, 6).alias("efficiency"))


def scale_table(timings: DataFrame, metric: str) -> DataFrame:
    """For scaleup (T of the smallest run / T) and sizeup (T / T of the smallest): size, seconds, and the metric."""
    base = F.first_value("seconds").over(Window.partitionBy().orderBy("size"))
    value = F.try_divide(base, F.col("seconds")) if metric == "scaleup" else F.try_divide(F.col("seconds"), base)
    return timings.select("size", "seconds", F.round(value, 6).alias(metric))
