"""What the operators need from the session: shared folders and their own code on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Puts this package on the Python path of every executor, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_logloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="logloom")), "logloom.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(to)
    sc._logloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that setting is absent (a local session, as in tests) a temporary
    folder of this machine takes its place.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        got = sc._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="logloom-shared")).as_uri()
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/logloom-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files as soon as it has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, to: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts lineage and outlives executors.

    Nothing else reads the shuffle files of the write, so they go with its end
    rather than when the driver's objects for its plan are collected.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(to)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes folders through Hadoop's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
