"""Small numeric expressions of the reports."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def share(value: Column) -> Column:
    """Percentage of the column's total; null if the total is 0."""
    return F.try_divide(value * 100.0, F.sum(value).over(Window.partitionBy()))


def memory_estimate(data_mb: Column, ips: Column) -> dict[str, Column]:
    """Megabytes that a single process would need for data_mb of logs with so many addresses.

    Fixed values: 1.5 times the data, 60 MB of geographic data, 80 and 200
    bytes an address, 50 MB besides.
    """
    mb = 1024.0 * 1024.0
    parts = {"log_buffer_mb": data_mb * 1.5, "geo_db_mb": F.lit(60.0), "ip_set_mb": ips * 80 / mb, "result_json_mb": ips * 200 / mb, "overhead_mb": F.lit(50.0)}
    total = parts["log_buffer_mb"] + parts["geo_db_mb"] + parts["ip_set_mb"] + parts["result_json_mb"] + parts["overhead_mb"]
    return {k: F.round(v, 2) for k, v in {**parts, "total_mb": total}.items()}
