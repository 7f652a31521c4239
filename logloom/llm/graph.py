"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import dropped, shared_dir, stored


def components(edges: DataFrame) -> DataFrame:
    """For each node with an edge its component's least node: columns node, root.

    edges: columns a, b, of one ordered type.  Alternating large-star and
    small-star steps (each node's neighbours are joined to their least
    neighbour) until nothing changes; every step is a join and an aggregation
    by node, written to the shared folder, so a component of any size stays
    distributed and a lost executor costs at most one step.  Adaptive execution
    splits the joins where a hub has most of the edges.  No edges: no rows.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark)
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{folder}/0")
    before, step = _print(e), 0
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/{step}")
        dropped(spark, f"{folder}/{step - 1}")
        after = _print(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _print(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
