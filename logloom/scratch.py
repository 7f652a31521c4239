"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        set_by_code = sc._jsc.sc().getCheckpointDir()
        base = set_by_code.get() if set_by_code.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/logloom-{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The table, written once: whatever reads it sees the same rows, also after executors are lost."""
    return materialized_at(df, folder(df.sparkSession, name))


def materialized_at(df: DataFrame, to: str) -> DataFrame:
    """The table, written to a path, in place of what may be there of an earlier attempt, and read from it."""
    df.write.mode("overwrite").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's own file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
