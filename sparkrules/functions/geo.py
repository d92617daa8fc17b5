"""Distances on the earth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088
#: Beyond this the flat approximation gives way to the haversine formula.
FLAT_KM = 1500.0


def distance_km(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    a, b = F.radians(lat.cast("double")), F.radians(other_lat.cast("double"))
    dlat, dlon = b - a, F.radians(other_lon.cast("double")) - F.radians(lon.cast("double"))
    x = dlon * F.cos((a + b) / 2)
    flat = F.lit(RADIUS_KM) * F.sqrt(x * x + dlat * dlat)
    sin_lat, sin_lon = F.sin(dlat / 2), F.sin(dlon / 2)
    h = sin_lat * sin_lat + F.cos(a) * F.cos(b) * sin_lon * sin_lon
    round_earth = F.lit(2 * RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    return F.when(flat <= FLAT_KM, flat).otherwise(round_earth)
