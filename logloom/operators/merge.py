"""Merging partitions' records into one table by address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(records: DataFrame, union_sites: bool = False) -> DataFrame:
    """One record per address: that of the highest rid, and of those the greatest; records without an address are dropped.

    An aggregation that keeps one record per address and task before the
    exchange.  union_sites: source_sites are those of all the address's records,
    as rebalancing may have dealt its tuples to several partitions.
    """
    rest = [c for c in records.columns if c not in ("ip", "rid")]
    aggregates = [F.max(F.struct("rid", *rest)).alias("r")]
    if union_sites:  # explode first, so that the partial aggregation holds a few distinct sites
        records = records.withColumn("__site", F.explode_outer("source_sites"))
        aggregates.append(F.sort_array(F.collect_set("__site")).alias("__sites"))
    kept = records.where("ip is not null").groupBy("ip").agg(*aggregates)
    return kept.select("ip", *[F.col("__sites" if union_sites and c == "source_sites" else f"r.{c}").alias(c) for c in rest])


def write_count(records: DataFrame) -> int:
    """Writes that records stand for: every one with an address, also where a later one replaces it."""
    return records.where("ip is not null").count()


def upserted(table: DataFrame, records: DataFrame) -> DataFrame:
    """table with records' rows in place of those with the same address; records must be distinct by address.

    Applying the same records again changes nothing.
    """
    new = records.where("ip is not null")
    return table.join(new.select("ip"), "ip", "left_anti").unionByName(new.select(*table.columns))
