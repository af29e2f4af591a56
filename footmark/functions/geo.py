"""Great-circle distance as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / F.lit(2.0))
    chord = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.lit(2.0) * F.lit(EARTH_RADIUS_KM) * F.asin(
        F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord))))
