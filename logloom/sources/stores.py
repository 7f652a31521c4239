"""Stores that the pipeline has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import exists

RECORD = "ip string, country string, city string, latitude double, longitude double, source_sites array<int>"


def read_intermediate(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records, with their rid, of intermediate JSON arrays named reducer_<rid>.json.

    Missing, empty and corrupt files are skipped.
    """
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], f"{RECORD}, rid int")
    rows = spark.read.schema(f"{RECORD}, _corrupt_record string").options(multiLine=True, mode="PERMISSIVE").json(found)
    rid = F.regexp_extract(F.col("_metadata.file_name"), r"reducer_(\d+)", 1).try_cast("int")
    return rows.withColumn("rid", rid).where("_corrupt_record is null").drop("_corrupt_record")


def read_json_store(spark: SparkSession, path: str) -> DataFrame:
    """Records of a central store: one JSON object by address, or an array of records.

    Such a file is one value, so one task reads it; the table that write_store writes has no such limit.

    Records of an array without an address are dropped.  A file that is neither gives no rows.
    """
    whole = spark.read.text(path, wholetext=True)
    keyed = F.from_json("value", f"map<string, struct<{_fields(RECORD)}>>")
    listed = F.from_json("value", f"array<struct<{_fields(RECORD)}>>")
    text = F.ltrim("value")
    objects = whole.where(text.startswith("{")).select(F.explode(F.map_entries(keyed)).alias("e")).select(F.col("e.key").alias("ip"), *[F.col(f"e.value.{c}").alias(c) for c in _names(RECORD)[1:]])
    lists = whole.where(text.startswith("[")).select(F.explode(listed).alias("e")).select("e.*").where("ip is not null and ip <> ''")
    return objects.unionByName(lists)


def completed_partitions(spark: SparkSession, pattern: str, n: int) -> DataFrame:
    """rid, done for 0..n-1: done if the partition has a file reducer_<rid>.json that isn't empty."""
    all_ = spark.range(n).select(F.col("id").cast("int").alias("rid"))
    if not exists(spark, pattern):
        return all_.withColumn("done", F.lit(False))
    files = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"reducer_(\d+)\.json$", 1).try_cast("int").alias("rid"), "length")
    ready = files.where("length > 0 and rid is not null").select("rid").distinct().withColumn("done", F.lit(True))
    return all_.join(ready, "rid", "left").withColumn("done", F.coalesce("done", F.lit(False)))


def failed_partitions(spark: SparkSession, pattern: str, n: int) -> DataFrame:
    """rid of the partitions that aren't done."""
    return completed_partitions(spark, pattern, n).where("not done").select("rid")


def _fields(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in schema.split(", ")))


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ", 1)[0] for f in schema.split(", ")]
