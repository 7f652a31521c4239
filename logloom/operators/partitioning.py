"""Routing of addresses to partitions, by hash or by sampled ranges.

A route is the column rid; physically Spark's own exchanges do the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import fnv_mod, ip_to_int


def hash_routed(tuples: DataFrame, n: int) -> DataFrame:
    """Adds rid = FNV-1a 64 of the address modulo n, -1 for a null address.

    As rid can't be null, no join on it makes Catalyst test the hash for null
    in a filter at the scan, where it would be computed for every line.
    """
    return tuples.withColumn("rid", F.coalesce(fnv_mod(F.col("ip"), n), F.lit(-1)))


def equal_width_bounds(n: int) -> list[int]:
    """Boundaries of n ranges of one width over 32 bits."""
    return [(1 << 32) // n * i for i in range(n + 1)]


def sampled(addresses: DataFrame, size: int) -> DataFrame:
    """ipn of ``size`` addresses, drawn by the hash of site, line and address: repeatable, and rows that repeat weigh more.

    addresses: ip and any columns that tell rows apart.
    """
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(addresses.columns)]))
    return addresses.select(key.alias("k"), ip_to_int(F.col("ip")).alias("ipn")).orderBy("k", "ipn").limit(size).select("ipn")


def weighted_sample(counts: DataFrame, size: int) -> DataFrame:
    """ipn of ``size`` draws from addresses that occur n times each; counts: ip, site_id, n.

    As if every occurrence were a row of ``sampled``, without those rows: an
    address gets at most ``size`` draws, as no more can be among the least, and
    their keys are scaled to the share that they stand for.  Repeatable.
    """
    some = F.least("n", F.lit(size))
    drawn = counts.select("ip", "site_id", (some / F.col("n")).alias("share"), F.explode(F.sequence(F.lit(1).cast("bigint"), some)).alias("j"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", "ip", F.col("site_id").cast("string"), F.col("j").cast("string"))), 1, 12), 16, 10).cast("double")
    return drawn.select((u * F.col("share")).alias("k"), ip_to_int(F.col("ip")).alias("ipn")).orderBy("k", "ipn").limit(size).select("ipn")


def quantile_bounds(sample: DataFrame, n: int) -> DataFrame:
    """One row with bounds: 0, the sample's values at places i/n of its size, and 2**32.

    An empty sample gives ranges of one width.  The sample is bounded by the
    size that was drawn, so gathering it is safe.
    """
    values = sample.agg(F.sort_array(F.collect_list("ipn")).alias("v"))
    size = F.size("v")
    cuts = [F.get("v", F.expr(f"cast(least(size(v) * {i} div {n}, size(v) - 1) as int)")) for i in range(1, n)]
    bounds = F.array(F.lit(0).cast("bigint"), *cuts, F.lit(1 << 32))
    return values.select(F.when(size == 0, F.array(*[F.lit(b).cast("bigint") for b in equal_width_bounds(n)])).otherwise(bounds).alias("bounds"))


def range_rid(ip_int: Column, bounds: Sequence[int]) -> Column:
    """The last range whose lower boundary isn't above the number; plain comparisons, so it stays in generated code."""
    inner = bounds[1:-1]
    return sum(((ip_int >= F.lit(b)).cast("int") for b in inner), F.lit(0)).cast("int")


def range_routed(tuples: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """Adds rid by boundaries (lowest, inner ones, highest)."""
    return tuples.withColumn("rid", range_rid(ip_to_int(F.col("ip")), bounds))


def fitted_bounds(addresses: DataFrame, n: int, size: int = 10_000) -> list[int]:
    """Boundaries for the driver: n + 1 numbers."""
    return list(quantile_bounds(sampled(addresses, size), n).first()["bounds"])


def boundary_report(bounds: Sequence[int]) -> str:
    """The last octets of each range's first and last address, as R0:0-255 | R1:..."""
    return " | ".join(f"R{i}:{lo % 256}-{(hi - 1) % 256}" for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))) or "no boundaries"


def grouped_ips(routed: DataFrame, most: int = 1_000_000) -> DataFrame:
    """rid with the list of its addresses.

    A list is one row of one task, so a partition of more than ``most``
    addresses is refused; write_partitions groups tables of any size.
    """
    rids = routed.groupBy("rid").agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).collect()
    if rids:
        raise ValueError(f"partition {rids[0]['rid']} has more than {most} addresses: use write_partitions")
    return routed.groupBy("rid").agg(F.sort_array(F.collect_list("ip")).alias("ips"))
