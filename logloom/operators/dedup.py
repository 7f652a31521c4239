"""Distinct addresses, within sites and over all."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialized


def local_distinct(tuples: DataFrame) -> DataFrame:
    """Distinct (ip, site_id).  Each task drops its own repeats before anything moves."""
    return tuples.select("ip", "site_id").distinct()


def first_occurrences(tuples: DataFrame) -> DataFrame:
    """ip, site_id, line_no of each address's first line at its site."""
    return tuples.groupBy("ip", "site_id").agg(F.min("line_no").alias("line_no"))


def global_distinct(tuples: DataFrame, sites: Iterable[int] | None = None) -> DataFrame:
    """One row per address with the sites that it appears at, ascending.

    sites: all site numbers that occur, where they are known and within 0 to 62.
    An address's sites are then one bit mask, so that the aggregation is a plain
    hash aggregation in generated code; sets of objects fall back to sorting
    once a task holds more than a few addresses.
    """
    if sites is None:
        return tuples.groupBy("ip").agg(F.sort_array(F.collect_set("site_id")).alias("source_sites"))
    known = sorted(set(sites))
    if known and not 0 <= known[0] <= known[-1] <= 62:
        raise ValueError("site numbers from 0 to 62 fit a mask")
    masks = tuples.groupBy("ip").agg(F.bit_or(F.expr("shiftleft(1L, site_id)")).alias("mask"))
    listed = F.array(*[F.when(F.expr(f"getbit(mask, {i})") == 1, F.lit(i)) for i in known]).cast("array<int>")
    return masks.select("ip", F.array_compact(listed).alias("source_sites"))


def pipeline_counts(lines: DataFrame, tuples: DataFrame) -> DataFrame:
    """One row: rows_read, ip_local, ip_global, skipped (local less global)."""
    per_ip = local_distinct(tuples).groupBy("ip").agg(F.count("*").alias("sites"))
    ips = per_ip.agg(F.coalesce(F.sum("sites"), F.lit(0)).cast("bigint").alias("ip_local"), F.count("*").alias("ip_global"))
    rows = lines.agg(F.count("*").alias("rows_read"))
    return rows.join(ips).select("rows_read", "ip_local", "ip_global", (F.col("ip_local") - F.col("ip_global")).alias("skipped"))


def chunk_hit_rates(routed: DataFrame, chunk_size: int = 2048, order: tuple[str, ...] = ("site_id", "ip"), n: int | None = None) -> DataFrame:
    """rid, chunk_id, received, local_dup, global_dup, hit_rate of chunks of each partition's tuples.

    Arrival order is ``order``.  local_dup: tuples whose address came before in
    their chunk; global_dup: before in their partition; hit_rate: global_dup per
    tuple, to four places.  Only statistics need these windows; the address
    windows are dealt by (rid, ip).  With the number n of partitions, one without
    tuples has one chunk, of nothing and with a hit rate of 0.
    """
    by = [F.col(c) for c in order]
    numbered = numbered_tuples(routed, order).withColumn("chunk_id", F.expr(f"(rn - 1) div {chunk_size}"))
    in_part = F.row_number().over(Window.partitionBy("rid", "ip").orderBy(*by))
    in_chunk = F.row_number().over(Window.partitionBy("rid", "ip", "chunk_id").orderBy(*by))
    marked = numbered.withColumns({"g": (in_part > 1).cast("bigint"), "l": (in_chunk > 1).cast("bigint")})
    sums = marked.groupBy("rid", "chunk_id").agg(F.count("*").alias("received"), F.sum("l").alias("local_dup"), F.sum("g").alias("global_dup"))
    rates = sums.withColumn("hit_rate", F.round(F.col("global_dup") / F.col("received"), 4))
    if n is None:
        return rates
    none = F.lit(0).cast("bigint")
    empty = routed.sparkSession.range(n).select(F.col("id").cast("int").alias("rid")).join(rates.select("rid").distinct(), "rid", "left_anti")
    return rates.unionByName(empty.select("rid", none.alias("chunk_id"), none.alias("received"), none.alias("local_dup"), none.alias("global_dup"), F.lit(0.0).alias("hit_rate")))


def chunk_summary(rates: DataFrame) -> DataFrame:
    """rid, n_chunks, avg_hit_rate, max_hit_rate; the mean, of rates of four places, to six."""
    mean = F.round((F.sum(F.round(F.col("hit_rate") * 10_000).cast("bigint")) / F.count("*")) / 10_000, 6)
    return rates.groupBy("rid").agg(F.count("*").alias("n_chunks"), mean.alias("avg_hit_rate"), F.max("hit_rate").alias("max_hit_rate"))


def numbered_tuples(routed: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Adds rn, the place of a row in its partition, without gathering a partition in one task.

    Rows are range-partitioned by (rid, order); a row's place is its place in its
    range plus the sizes of the partition's ranges before it.  Ranges come from a
    sample that another run would draw anew, so the rows are written with theirs.
    """
    sorted_ = materialized(routed.repartitionByRange("rid", *order).withColumn("__slice", F.spark_partition_id()), "slices")
    sizes = sorted_.groupBy("rid", "__slice").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("rid").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("rid", "__slice", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("rid", "__slice").orderBy(*order))
    return sorted_.withColumn("__place", place).join(starts, ["rid", "__slice"]).withColumn("rn", F.col("__place") + F.col("__before")).drop("__slice", "__place", "__before")
