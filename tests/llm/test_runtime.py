"""What stored tables leave behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from logloom.llm import runtime


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for f in folders for p in Path(f).rglob("shuffle_*.data")}


def test_a_stored_table_frees_its_shuffle_files(spark, tmp_path):
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids"))
    before, setting = _shuffle_files(spark), spark.conf.get(runtime._CLEANUP, None)
    out = runtime.stored(df, (tmp_path / "t").as_uri())
    assert spark.conf.get(runtime._CLEANUP, None) == setting
    deadline = time.monotonic() + 20
    while (left := _shuffle_files(spark) - before) and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not left
    assert out.count() == df.count() == 100  # both can still be read
    assert out.selectExpr("sum(size(ids))").first()[0] == 10_000
