"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own,
given by an offset and a step hashed from its name; the shards take turns at
claiming their next free slot until the table is full.  Shards then differ by
one slot at most, and taking a shard away or adding one moves few keys that it
doesn't own.  Rows are placed by one look-up in the broadcast table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime at least a hundred times the number of shards keeps them even.
SLOTS = 65_537
MAX_SLOTS = 1 << 21


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard number of every slot."""
    if not _prime(slots) or slots > MAX_SLOTS or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError(f"a prime number of slots up to {MAX_SLOTS} and between 1 and that many distinct shard names are needed")
    hashes = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(h[:8]) % slots for h in hashes]
    step = [int.from_bytes(h[8:]) % (slots - 1) + 1 for h in hashes]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its text's MD5, modulo the number of slots.  Null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def placed(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Adds slot and shard to every row (columns of those names are replaced).

    The table, at most MAX_SLOTS rows of two numbers whatever the data's size,
    is broadcast: no shuffle, so a key that many rows share costs nothing extra.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard int")
    names = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    rows = df.withColumn("__slot", slot(F.col(f"`{key}`"), slots)).select(*[F.col(f"`{c}`") for c in names], F.col("__slot").alias("slot"))
    return rows.join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in names], "slot", "shard")


def write_shards(df: DataFrame, to: str, key: str, shards: Sequence[str], slots: int = SLOTS, files: int = 1, mode: str = "errorifexists") -> None:
    """Writes one Parquet folder per shard (shard=0, 1, ...), with about ``files`` files in each.

    A shard's rows are dealt to its files by a hash of the whole row, so
    neither a large shard nor a key with many rows has to pass through one task
    when files is more than 1.
    """
    rows = placed(df, key, shards, slots)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(files))
    rows.withColumn("__file", part).repartition(len(shards) * files, "shard", "__file").drop("__file").write.mode(mode).partitionBy("shard").parquet(to)
