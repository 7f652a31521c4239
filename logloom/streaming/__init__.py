"""Streaming form of the deduplication; an extension, as the batch pipeline has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.net import parse_ip
from ..operators.merge import upserted
from ..sources.logs import exists


def distinct_tuples(lines: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Distinct (ip, site_id) of a stream of site_id, raw_line.

    With an event time column, state older than ``delay`` is dropped and only
    repeats within it are; without one, all tuples stay in the state.
    """
    found = lines.withColumn("ip", parse_ip(F.col("raw_line"))).where("ip <> ''")
    if time:
        return found.withWatermark(time, delay).dropDuplicatesWithinWatermark(["ip", "site_id"]).select("ip", "site_id", time)
    return found.select("ip", "site_id").dropDuplicates(["ip", "site_id"])


def store_sink(tuples: DataFrame, to: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps <to>/v<batch> as one row per address with its sites, a new version for each micro-batch.

    A batch that runs again writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("ip").agg(F.collect_set("site_id").alias("new"))
        before = next((f"{to}/v{k}" for k in range(number - 1, -1, -1) if exists(spark, f"{to}/v{k}/_SUCCESS")), None)
        if before:
            old = spark.read.parquet(before)
            joined = new.join(old, "ip", "left").select("ip", F.sort_array(F.array_union("new", F.coalesce("source_sites", F.array().cast("array<int>")))).alias("source_sites"))
            table = upserted(old, joined)
        else:
            table = new.select("ip", F.sort_array("new").alias("source_sites"))
        table.write.mode("overwrite").parquet(f"{to}/v{number}")

    return tuples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
