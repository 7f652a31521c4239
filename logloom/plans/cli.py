"""Command line: spark-submit -m logloom.plans.cli ROOT [options]."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from ..config import PipelineConfig, datasets, replace
from ..operators import reports
from ..sources import network_path
from .monitor import Monitor
from .pipeline import run, validated
from .sweeps import MEMORY_THRESHOLDS, REDUCERS, SKEW_THRESHOLDS, all_sweeps, write_sweeps


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Unique client addresses of several sites' access logs")
    p.add_argument("root", help="folder of the datasets")
    p.add_argument("-r", "--reducers", type=int, default=4)
    p.add_argument("-o", "--output", default="output")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--dataset", choices=["balanced", "csv", "csv9k", "skew"], default="balanced")
    p.add_argument("--csv", action="store_const", const="csv", dest="dataset")
    p.add_argument("--csv9k", action="store_const", const="csv9k", dest="dataset")
    p.add_argument("--partition", choices=["hash", "range"], default="hash")
    p.add_argument("--skew-threshold", type=float, default=0.5)
    p.add_argument("--validate", action="store_true")
    p.add_argument("--validation-only", action="store_true")
    p.add_argument("--networks", help="table of networks for places; looked for in ROOT and the working directory without it")
    p.add_argument("--memory-threshold", type=float, default=80.0)
    p.add_argument("--sweep", action="store_true", help="runs over numbers of partitions, memory and skew thresholds")
    p.add_argument("--benchmark", choices=["all", "speedup", "scaleup", "sizeup"])
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Validation alone, else a benchmark or sweeps, else a run; 0 unless a validation fails."""
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("logloom").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "WARN")
    dataset = datasets(a.root)[a.dataset]
    if not a.validation_only and a.benchmark:
        for kind in ("speedup", "scaleup", "sizeup") if a.benchmark == "all" else (a.benchmark,):
            benchmark(spark, dataset, a.output, kind).show()
        return 0
    if not a.validation_only and a.sweep:
        found = all_sweeps(spark, {a.dataset: dataset}, f"{a.output}/sweep-run")
        settings = {"reducers": REDUCERS, "memory_thresholds": MEMORY_THRESHOLDS, "skew_thresholds": SKEW_THRESHOLDS}
        write_sweeps(spark, found, [a.dataset], settings, f"{a.output}/sweep_{time.strftime('%Y%m%d_%H%M%S')}")
        return 0
    if not a.validation_only:
        networks = a.networks or network_path(spark, a.root, ".")
        config = PipelineConfig(n_reducers=a.reducers, strategy=a.partition, skew_threshold=a.skew_threshold, networks=networks, memory_threshold=a.memory_threshold)
        monitor = Monitor(a.memory_threshold)
        print(json.dumps(run(spark, dataset, a.output, config, monitor)))
        for text in (monitor.memory_report() if a.verbose else "", monitor.failure_report()):
            if text:
                print(text)
    if a.validate or a.validation_only:
        found = validated(spark, dataset, a.output).first().asDict()
        print(json.dumps(found))
        return 0 if found["passed"] else 1
    return 0


def benchmark(spark: SparkSession, dataset, to: str, kind: str, sizes: tuple[int, ...] = (1, 2, 4, 6)):
    """Timed runs over numbers of partitions (speedup), or over so many copies of the input (scaleup, with as many partitions, and sizeup).

    A copy is the dataset once more, as sites of other numbers: sizes grow
    beyond the number of sites.
    """
    rows = []
    for n in sizes:
        copies = 1 if kind == "speedup" else n
        part = replace(dataset, files={i + k * 10: p for k in range(copies) for i, p in dataset.files.items()})
        began = time.perf_counter()
        run(spark, part, f"{to}/bench", PipelineConfig(n_reducers=4 if kind == "sizeup" else n))
        rows.append((n, time.perf_counter() - began))
    if kind == "speedup":
        return reports.speedup_table(spark.createDataFrame(rows, "n int, seconds double"))
    return reports.scale_table(spark.createDataFrame(rows, "size int, seconds double"), kind)


if __name__ == "__main__":
    raise SystemExit(main())
