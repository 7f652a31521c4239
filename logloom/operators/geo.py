"""Location of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import geo_columns
from ..functions.net import fnv1a_64, ip_to_int, is_address

FIELDS = ["ip", "country", "city", "latitude", "longitude"]
#: Bits below the cells under which networks are listed.
LEVELS = (6, 12, 18, 24)


def address_number(ip: str = "ip") -> Column:
    """The number that stands for an address: its 32 bits, or for what isn't one the high half of its FNV hash."""
    c = F.col(ip)
    dotted = c.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
    return F.when(dotted, ip_to_int(c)).otherwise(fnv1a_64(c)["hi"])


def with_synthetic_geo(ips: DataFrame) -> DataFrame:
    """Adds country, city, latitude, longitude.  Call it on distinct addresses, so each is computed once."""
    keyed = ips.withColumn("__n", address_number())
    return keyed.withColumns(geo_columns(F.col("__n"))).drop("__n")


def with_range_geo(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """Location from a table of networks (lo, hi, country, city, latitude, longitude), the synthetic one where none fits.

    A network narrower than 2**s is listed under the cells of 2**s addresses
    that it touches, at most two, for the least s of LEVELS that fits; wider
    ones under their first octets.  An address looks up its cell of every level,
    so this is an equi-join on (level, cell), and where networks are apart or
    nested a cell lists at most 64 of them for each level of nesting, however
    large the table; Spark broadcasts it only if it is small.  Of several
    networks the narrowest counts, then the lowest.  Missing names become
    "Unknown", missing degrees 0.  Texts that are no whole address fit none.
    """
    width = F.col("hi") - F.col("lo")
    level = F.lit(LEVELS[-1])
    for s in reversed(LEVELS[:-1]):
        level = F.when(width < 1 << s, s).otherwise(level)
    spread = networks.where("lo <= hi and hi >= 0 and lo < 4294967296").withColumn("level", level).withColumn("cell", F.explode(F.expr("sequence(shiftright(greatest(lo, 0), level), shiftright(least(hi, 4294967295), level))")))
    places = F.struct(
        width.alias("width"), F.col("lo"),
        F.coalesce(F.nullif(F.col("country"), F.lit("")), F.lit("Unknown")).alias("country"), F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("Unknown")).alias("city"),
        F.coalesce("latitude", F.lit(0.0)).alias("latitude"), F.coalesce("longitude", F.lit(0.0)).alias("longitude"),
    )
    keyed = ips.select("ip").distinct().where(is_address(F.col("ip"))).withColumn("n", ip_to_int(F.col("ip")))
    keyed = keyed.withColumn("level", F.explode(F.array(*[F.lit(s) for s in LEVELS]))).withColumn("cell", F.expr("shiftright(n, level)"))
    met = keyed.join(spread.select("level", "cell", "lo", "hi", places.alias("place")), ["level", "cell"]).where("n between lo and hi")
    best = met.groupBy("ip").agg(F.min("place").alias("place"))
    found = with_synthetic_geo(ips).join(best, "ip", "left")
    return found.select(*ips.columns, *[F.when(F.col("place").isNotNull(), F.col(f"place.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS[1:]])


def located(ips: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """Adds country, city, latitude, longitude: from networks if given, else synthetic ones."""
    return with_synthetic_geo(ips) if networks is None else with_range_geo(ips, networks)
