"""Spark-native analytics for multi-site web access logs.

The names below are imported when first asked for, so importing the package
alone loads nothing.
"""

from importlib import import_module

_HOMES = {
    "logloom.config": ["SITES", "Dataset", "PipelineConfig", "datasets"],
    "logloom.functions": ["combined_fields", "fnv1a_64", "fnv_mod", "int_to_ip", "ip_to_int", "is_address", "is_combined", "memory_estimate", "parse_ip"],
    "logloom.sources": ["completed_partitions", "csv_lines", "dataset_tuples", "failed_partitions", "log_lines", "network_path", "numbered_lines", "read_intermediate", "read_json_store", "read_networks"],
    "logloom.sinks": ["clean_orphans", "write_csv", "write_json_object", "write_partitions", "write_store"],
    "logloom.operators.dedup": ["chunk_hit_rates", "chunk_summary", "global_distinct", "local_distinct", "pipeline_counts"],
    "logloom.operators.geo": ["located", "with_range_geo", "with_synthetic_geo"],
    "logloom.operators.partitioning": ["boundary_report", "equal_width_bounds", "fitted_bounds", "grouped_ips", "hash_routed", "range_routed"],
    "logloom.operators.rebalance": ["planned_moves", "rebalanced", "steal_stats"],
    "logloom.operators.merge": ["merged", "upserted"],
    "logloom.operators.reports": ["format_check", "latency_share", "scale_table", "speedup_table"],
    "logloom.operators.skew": ["hot_cold", "received_counts", "skew_factor", "unique_share"],
    "logloom.operators.validate": ["baseline_ips", "count_check", "extra_ips", "missing_ips"],
    "logloom.plans.monitor": ["Failure", "Monitor", "PartFailure", "PartTimeout", "memory_snapshot", "with_timeout"],
    "logloom.plans.pipeline": ["partition_records", "recovered", "run", "store", "validated"],
    "logloom.plans.sweeps": ["all_sweeps", "memory_sweep", "skew_sweep", "speedup_sweep", "sweep", "write_sweeps"],
    "logloom.plans.cli": ["benchmark"],
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}

__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOME[name]), name)
