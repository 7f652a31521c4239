"""Location of addresses without a geographic database."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country, city, base latitude and longitude by index.
CITIES = [
    ("United States", "New York", 40.7128, -74.006),
    ("United States", "Los Angeles", 34.0522, -118.2437),
    ("United States", "Chicago", 41.8781, -87.6298),
    ("United States", "Seattle", 47.6062, -122.3321),
    ("United States", "San Francisco", 37.7749, -122.4194),
    ("United States", "Houston", 29.7604, -95.3698),
    ("United States", "Miami", 25.7617, -80.1918),
    ("United States", "Boston", 42.3601, -71.0589),
    ("United Kingdom", "London", 51.5074, -0.1278),
    ("United Kingdom", "Manchester", 53.4808, -2.2426),
    ("Germany", "Berlin", 52.52, 13.405),
    ("Germany", "Munich", 48.1351, 11.582),
    ("France", "Paris", 48.8566, 2.3522),
    ("Netherlands", "Amsterdam", 52.3676, 4.9041),
    ("Spain", "Madrid", 40.4168, -3.7038),
    ("Italy", "Rome", 41.9028, 12.4964),
    ("Poland", "Warsaw", 52.2297, 21.0122),
    ("Sweden", "Stockholm", 59.3293, 18.0686),
    ("Norway", "Oslo", 59.9139, 10.7522),
    ("Denmark", "Copenhagen", 55.6761, 12.5683),
    ("Japan", "Tokyo", 35.6762, 139.6503),
    ("Japan", "Osaka", 34.6937, 135.5023),
    ("South Korea", "Seoul", 37.5665, 126.978),
    ("China", "Beijing", 39.9042, 116.4074),
    ("China", "Shanghai", 31.2304, 121.4737),
    ("Hong Kong", "Hong Kong", 22.3193, 114.1694),
    ("Taiwan", "Taipei", 25.033, 121.5654),
    ("Singapore", "Singapore", 1.3521, 103.8198),
    ("India", "Mumbai", 19.076, 72.8777),
    ("India", "New Delhi", 28.6139, 77.209),
    ("India", "Bangalore", 12.9716, 77.5946),
    ("Thailand", "Bangkok", 13.7563, 100.5018),
    ("Vietnam", "Ho Chi Minh City", 10.8231, 106.6297),
    ("Vietnam", "Hanoi", 21.0285, 105.8542),
    ("Indonesia", "Jakarta", -6.2088, 106.8456),
    ("Philippines", "Manila", 14.5995, 120.9842),
    ("Malaysia", "Kuala Lumpur", 3.139, 101.6869),
    ("Australia", "Sydney", -33.8688, 151.2093),
    ("Australia", "Melbourne", -37.8136, 144.9631),
    ("Brazil", "Sao Paulo", -23.5505, -46.6333),
    ("Brazil", "Rio de Janeiro", -22.9068, -43.1729),
    ("Argentina", "Buenos Aires", -34.6037, -58.3816),
    ("Mexico", "Mexico City", 19.4326, -99.1332),
    ("Canada", "Toronto", 43.6532, -79.3832),
    ("Canada", "Vancouver", 49.2827, -123.1207),
    ("Russia", "Moscow", 55.7558, 37.6173),
    ("South Africa", "Johannesburg", -26.2041, 28.0473),
    ("United Arab Emirates", "Dubai", 25.2048, 55.2708),
    ("Turkey", "Istanbul", 41.0082, 28.9784),
    ("Israel", "Tel Aviv", 32.0853, 34.7818),
    ("Nigeria", "Lagos", 6.5244, 3.3792),
    ("Egypt", "Cairo", 30.0444, 31.2357),
]


def city(ip_int: Column) -> Column:
    """Index of the city that a number stands for."""
    return F.pmod(F.abs(ip_int), F.lit(len(CITIES)))


def _looked_up(index: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def geo_columns(ip_int: Column) -> dict[str, Column]:
    """country, city, latitude and longitude for an address's number.

    Latitude and longitude move off the city by up to 0.0999 degrees.  They are
    computed in whole ten-thousandths, which gives the same doubles as rounding
    the sum to six places; no city comes near the limits of the scales.
    """
    n, i = F.abs(ip_int), city(ip_int)
    size = len(CITIES)
    north = F.pmod(_div(n, size), F.lit(1000))
    east = F.pmod(_div(n, size * 1000), F.lit(1000))
    return {
        "country": _looked_up(i, [c[0] for c in CITIES]),
        "city": _looked_up(i, [c[1] for c in CITIES]),
        "latitude": (_looked_up(i, [round(c[2] * 10_000) for c in CITIES]) + north) / F.lit(10_000.0),
        "longitude": (_looked_up(i, [round(c[3] * 10_000) for c in CITIES]) + east) / F.lit(10_000.0),
    }


def _div(n: Column, by: int) -> Column:
    """Whole-number quotient of a number that isn't negative."""
    return ((n - F.pmod(n, F.lit(by))) / F.lit(by)).cast("bigint")
