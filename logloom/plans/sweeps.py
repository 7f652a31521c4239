"""Runs over ranges of settings."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from ..config import Dataset, PipelineConfig
from ..operators import validate
from ..sources import dataset_tuples
from .pipeline import run

#: Settings that ``all_sweeps`` goes through.
REDUCERS, MEMORY_THRESHOLDS, SKEW_THRESHOLDS = (1, 2, 4, 6, 8, 12), (70.0, 80.0, 90.0, 95.0), (0.2, 0.5, 1.0)


def sweep(spark: SparkSession, dataset: Dataset, to: str, name: str, values: Sequence, base: PipelineConfig | None = None) -> list[dict]:
    """A run for each value of one setting: label, params, ok, and its figures or error.  A failed run doesn't end the sweep."""
    out = []
    for v in values:
        row = {"label": f"{name}={v}", "params": {name: v}}
        try:
            row |= {"ok": True, **run(spark, dataset, to, replace(base or PipelineConfig(), **{name: v}))}
        except Exception as e:
            row |= {"ok": False, "error": f"{type(e).__name__}: {e}"[:500]}
        out.append(row)
    return out


def speedup_sweep(spark: SparkSession, dataset: Dataset, to: str, reducers: Sequence[int] = REDUCERS, check: bool = False) -> list[dict]:
    """Runs over numbers of partitions, with the speedup against the first that succeeds; check: whether counts match the input's."""
    rows = sweep(spark, dataset, to, "n_reducers", reducers)
    base = next((r["duration_s"] for r in rows if r["ok"]), None)
    ips = dataset_tuples(spark, dataset).select("ip").distinct().count() if check else None
    for r in rows:
        if r["ok"]:
            r["speedup"] = base / r["duration_s"]
            if check:
                r["counts_match"] = r["ip_global"] == ips
    return rows


def memory_sweep(spark: SparkSession, dataset: Dataset, to: str, thresholds: Sequence[float] = MEMORY_THRESHOLDS) -> list[dict]:
    return sweep(spark, dataset, to, "memory_threshold", thresholds)


def skew_sweep(spark: SparkSession, dataset: Dataset, to: str, thresholds: Sequence[float] = SKEW_THRESHOLDS) -> list[dict]:
    """Runs over skew thresholds, with whether the skew before any move was above."""
    rows = sweep(spark, dataset, to, "skew_threshold", thresholds)
    for r in rows:
        if r["ok"]:
            r["skew_warning_triggered"] = r["skew_received"] > r["params"]["skew_threshold"]
    return rows


def all_sweeps(spark: SparkSession, sources: Mapping[str, Dataset], to: str) -> dict[str, list[dict]]:
    """Speedup, memory and skew sweeps of every dataset by name; the counts of csv datasets are checked."""
    out = {}
    for name, dataset in sources.items():
        out[f"{name}_speedup"] = speedup_sweep(spark, dataset, to, check=dataset.kind == "csv")
        out[f"{name}_memory"] = memory_sweep(spark, dataset, to)
        out[f"{name}_skew"] = skew_sweep(spark, dataset, to)
    return out


def write_sweeps(spark: SparkSession, sweeps: Mapping[str, list[dict]], sources: Sequence[str], config: Mapping, to: str) -> None:
    """One JSON document: timestamp, data_sources, config and the sweeps by name."""
    body = {"timestamp": time.strftime("%Y%m%d_%H%M%S"), "data_sources": list(sources), "config": dict(config), "sweeps": dict(sweeps)}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(to)


def counts_match(spark: SparkSession, dataset: Dataset, to: str) -> bool:
    """Whether a run's store has as many addresses as its input."""
    return validate.count_check(dataset_tuples(spark, dataset), spark.read.parquet(f"{to}/store")).first()["passed"]
