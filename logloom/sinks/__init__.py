"""Writers.  Spark's committers make each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitions(records: DataFrame, to: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Records by rid; a run replaces what an earlier one left, unless the mode is append."""
    records.write.mode(mode).partitionBy("rid").format(fmt).save(to)


def write_store(records: DataFrame, to: str, fmt: str = "json") -> None:
    """The central table, one record per address, as JSON lines or another format; written by many tasks."""
    records.write.mode("overwrite").format(fmt).save(to)


def write_json_object(records: DataFrame, to: str, most: int = 1_000_000) -> None:
    """The central table as one JSON object keyed by address.

    One task has to build it, so more than ``most`` records are refused; write_store has no such limit.
    """
    rows = records.limit(most + 1)
    if rows.count() > most:
        raise ValueError(f"more than {most} records: use write_store")
    record = F.struct(*[F.col(c) for c in records.columns])
    whole = rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("ip"), record.alias("r"))))).alias("m"))
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(to)


def write_csv(df: DataFrame, to: str) -> None:
    """CSV with a header; quotes inside values are doubled."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(to)


def clean_orphans(spark, folder: str) -> int:
    """Deletes reducer_*.json and reducer_*.tmp in a folder; returns how many of the former there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for ending in ("json", "tmp"):
        pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/reducer_*.{ending}")
        store = pattern.getFileSystem(conf)
        for status in store.globStatus(pattern) or ():
            store.delete(status.getPath(), True)
            gone += ending == "json"
    return gone
