"""Tables of networks that give addresses their places."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import ip_to_int, is_address
from .logs import exists

NETWORK = "lo bigint, hi bigint, country string, city string, latitude double, longitude double"
#: Names under which a table of networks is looked for, in a folder's data folder and in the folder.
NAMES = ("networks.parquet", "networks.csv")


def network_path(spark: SparkSession, *folders: str) -> str | None:
    """The first table of networks found in <folder>/data or <folder>, in the folders' order."""
    return next((p for f in folders for at in (f"{f}/data", f) for p in (f"{at}/{n}" for n in NAMES) if exists(spark, p)), None)


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """NETWORK rows of a CSV (with a header, if the name ends in .csv) or Parquet table.

    A row's addresses are those of ``network`` (a.b.c.d/bits) or from ``lo`` to
    ``hi``; rows with neither are dropped, and other columns that are missing are null.
    """
    raw = spark.read.options(header=True, quote='"', escape='"').csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    have = {c.lower(): F.col(f"`{c}`") for c in raw.columns}
    fields = [f.strip().split(" ") for f in NETWORK.split(",")]
    own = {n: have[n].try_cast(t) if n in have else F.lit(None).cast(t) for n, t in fields}
    if "network" in have:
        base, bits = F.split_part(have["network"], F.lit("/"), F.lit(1)), F.split_part(have["network"], F.lit("/"), F.lit(2)).try_cast("int")
        good = is_address(base) & bits.between(0, 32)
        size = F.when(good, F.expr("1L") * F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint"))
        lo = ip_to_int(base) - F.pmod(ip_to_int(base), size)
        own |= {"lo": F.coalesce(F.when(good, lo), own["lo"]), "hi": F.coalesce(F.when(good, lo + size - 1), own["hi"])}
    return raw.select(*[own[n].alias(n) for n, _ in fields]).where("lo is not null and hi is not null")


def opened(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The table at a path, or None, for synthetic places, if there is no path, no file, or none that can be read."""
    if path is None or not exists(spark, path):
        return None
    try:
        table = read_networks(spark, path)
        table.limit(1).collect()
        return table
    except (PySparkException, Py4JError) as e:
        logging.getLogger(__name__).warning("no networks from %s, places are synthetic: %s", path, e)
        return None
