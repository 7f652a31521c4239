"""Readers."""

from .logs import LOG_SCHEMA, csv_lines, csv_tuples, dataset_rows, dataset_tuples, events_log, log_lines, log_tuples, numbered_lines
from .networks import NETWORK, network_path, opened, read_networks
from .stores import RECORD, completed_partitions, failed_partitions, read_intermediate, read_json_store

__all__ = ["LOG_SCHEMA", "NETWORK", "RECORD", "completed_partitions", "csv_lines", "csv_tuples", "dataset_rows", "dataset_tuples", "events_log", "failed_partitions", "log_lines", "log_tuples", "network_path", "numbered_lines", "opened", "read_intermediate", "read_json_store", "read_networks"]
