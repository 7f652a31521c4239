"""A run of the pipeline: read, remove repeats, route, rebalance, locate, write, validate."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Dataset, PipelineConfig
from ..operators import dedup, geo, merge, partitioning, rebalance, skew, validate
from ..scratch import dropped, materialized_at, folder
from ..sinks import clean_orphans, write_partitions, write_store
from ..sources import csv_lines, dataset_rows, dataset_tuples, log_lines, opened
from ..sources.logs import exists
from .monitor import Monitor

R = TypeVar("R")


def store(tuples: DataFrame, sites: Iterable[int] | None = None) -> DataFrame:
    """One row per address with its location and the sites that it appears at.

    tuples may repeat: Catalyst plans a partial aggregation before the only
    exchange, and locations are computed after it, once per address.
    """
    return geo.with_synthetic_geo(dedup.global_distinct(tuples, sites)).select(*geo.FIELDS, "source_sites")


def routed(tuples: DataFrame, config: PipelineConfig, bounds: list[int] | None = None) -> DataFrame:
    """Adds rid by the configured strategy."""
    if config.strategy == "range":
        return partitioning.range_routed(tuples, bounds or partitioning.equal_width_bounds(config.n_reducers))
    return partitioning.hash_routed(tuples, config.n_reducers)


def partition_records(tuples: DataFrame, compat_source_sites: bool = False, networks: DataFrame | None = None) -> DataFrame:
    """Records of each partition: rid, address, location, sites.

    compat_source_sites: every address of a partition bears all sites that the partition has seen.
    networks: a table that gives addresses their places; synthetic ones without it.
    """
    if not compat_source_sites:
        ips = tuples.groupBy("rid", "ip").agg(F.sort_array(F.collect_set("site_id")).alias("source_sites"))
    else:
        sites = tuples.groupBy("rid").agg(F.sort_array(F.collect_set("site_id")).alias("source_sites"))
        ips = tuples.select("rid", "ip").distinct().join(F.broadcast(sites), "rid")  # one row of a few sites per partition
    return geo.located(ips, networks).select("rid", *geo.FIELDS, "source_sites")


def with_retries(task: Callable[[], R], config: PipelineConfig, sleep: Callable[[float], None] = time.sleep) -> R:
    """Runs a job up to max_attempts times, pausing backoff_base ** k seconds before attempt k + 1."""
    return Monitor().retried(task, config.max_attempts, base=config.backoff_base, sleep=sleep)


def site_counts(rows: DataFrame) -> DataFrame:
    """ip, site_id, sampled, n: how many lines or records bear an address at a site; '' for those without one."""
    return rows.groupBy("ip", "site_id", "sampled").agg(F.count("*").alias("n"))


def run(spark: SparkSession, dataset: Dataset, to: str, config: PipelineConfig | None = None, monitor: Monitor | None = None) -> dict:
    """Writes <to>/intermediate (by rid) and <to>/store, and returns the run's figures.

    The input is read once: everything else, the range sample and the figures
    too, comes from the counts of each address at each site, which are written
    to the shared folder and deleted at the end.  ``monitor`` gets the phases'
    seconds, memory and failures.
    """
    config = config or PipelineConfig()
    monitor = monitor or Monitor(config.memory_threshold)
    work = folder(spark, "run")

    def retried(task: Callable[[], R], part: str) -> R:
        return monitor.retried(task, config.max_attempts, part, config.backoff_base)

    began = time.perf_counter()
    monitor.orphans += clean_orphans(spark, f"{to}/intermediate")
    with monitor.phase("extract"):
        counted = retried(lambda: materialized_at(site_counts(dataset_rows(spark, dataset)), f"{work}/counted"), "extract")
        local = dedup.local_distinct(counted.where("ip <> ''"))
    bounds, sampling_skew = None, 0.0
    if config.strategy == "range":
        with monitor.phase("sample"):
            drawn = partitioning.weighted_sample(counted.where("sampled <> ''").groupBy(F.col("sampled").alias("ip"), "site_id").agg(F.sum("n").alias("n")), config.sample_size)
            sample = spark.createDataFrame([(r.ipn,) for r in drawn.collect()], "ipn bigint")  # at most sample_size numbers
            bounds = list(partitioning.quantile_bounds(sample, config.n_reducers).first()["bounds"])
            sampled = sample.select(partitioning.range_rid(F.col("ipn"), bounds).alias("rid"))
            sampling_skew = skew.skew_factor(skew.received_counts(sampled, config.n_reducers)).first()["skew"]
    with monitor.phase("route"):
        local = retried(lambda: materialized_at(routed(local, config, bounds), f"{work}/routed"), "route")
        skew_received = skew.skew_factor(skew.received_counts(local, config.n_reducers)).first()["skew"]
        moves: list[rebalance.Move] = []
        if config.rebalance:
            local, moves = rebalance.rebalanced(local, config.n_reducers, config.skew_threshold, config.steal_iterations, written=True)
        figures = skew.skew_factor(skew.received_counts(local, config.n_reducers), threshold=config.skew_threshold).first().asDict()
    with monitor.phase("reduce"):
        networks = opened(spark, config.networks)
        retried(lambda: write_partitions(partition_records(local, config.compat_source_sites, networks), f"{to}/intermediate"), "reduce")
    with monitor.phase("merge"):
        n_ips = retried(lambda: _stored(spark, to, config), "merge")
    totals = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read")).first().asDict()
    n_local = local.count()
    dropped(spark, work)
    seconds = time.perf_counter() - began
    totals |= {"ip_local": n_local, "ip_global": n_ips, "skipped": n_local - n_ips}
    return totals | figures | rebalance.steal_stats(moves) | {
        "skew_received": skew_received, "sampling_skew": sampling_skew, "duration_s": seconds, "rows_per_s": totals["rows_read"] / seconds, "ips_per_s": n_ips / seconds, "strategy": config.strategy, "n_reducers": config.n_reducers,
        "boundaries": partitioning.boundary_report(bounds) if bounds else "", "geo_mode": "networks" if networks is not None else "synthetic", "phases": json.dumps(dict(monitor.phases)), "failures": len(monitor.failures), "recovered": monitor.recovered, "over_memory_threshold": monitor.over_threshold,
    }


def _stored(spark: SparkSession, to: str, config: PipelineConfig) -> int:
    """Merges <to>/intermediate into <to>/store; how many records that has."""
    if not exists(spark, f"{to}/intermediate/rid=*"):
        dropped(spark, f"{to}/store")
        return 0
    write_store(merge.merged(spark.read.parquet(f"{to}/intermediate"), not config.compat_source_sites), f"{to}/store", "parquet")
    return spark.read.parquet(f"{to}/store").count()


def missing_partitions(spark: SparkSession, to: str, n: int) -> list[int]:
    """The partitions of <to>/intermediate that have no file; those that got no tuples are among them."""
    return [k for k in range(n) if not exists(spark, f"{to}/intermediate/rid={k}/*.parquet")]


def recovered(spark: SparkSession, local: DataFrame, to: str, config: PipelineConfig) -> list[int]:
    """Computes only the partitions that <to>/intermediate lacks, from routed tuples (ip, site_id, rid), and merges anew; returns them.

    What other partitions hold stays as it is.
    """
    missing = missing_partitions(spark, to, config.n_reducers)
    if missing:
        records = partition_records(local.where(F.col("rid").isin(*missing)), config.compat_source_sites, opened(spark, config.networks))
        write_partitions(records, f"{to}/intermediate", mode="append")
        _stored(spark, to, config)
    return missing


def validated(spark: SparkSession, dataset: Dataset, to: str, allow_empty: bool = False) -> DataFrame:
    """The validation report of a run; csv datasets are compared with their unified file where there is one."""
    if dataset.kind == "csv" and dataset.unified and exists(spark, dataset.unified):
        baseline = validate.baseline_ips(csv_lines(spark, {0: dataset.unified}))
    elif dataset.kind == "csv":
        baseline = dataset_tuples(spark, dataset).select("ip").distinct()
    else:
        baseline = validate.baseline_ips(log_lines(spark, dataset.files))
    written = spark.read.parquet(f"{to}/store") if exists(spark, f"{to}/store") else spark.createDataFrame([], "ip string")
    return validate.report(baseline, written, allow_empty)
