"""Column expressions; all of them run inside the JVM."""

from .geo import CITIES, city, geo_columns
from .net import COMBINED, IP, combined_fields, fnv1a_64, fnv_mod, int_to_ip, ip_to_int, is_address, is_combined, parse_ip, sample_ip
from .numeric import memory_estimate, share

__all__ = ["CITIES", "COMBINED", "IP", "city", "combined_fields", "fnv1a_64", "fnv_mod", "geo_columns", "int_to_ip", "ip_to_int", "is_address", "is_combined", "memory_estimate", "parse_ip", "sample_ip", "share"]
