"""Great-circle geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopwise.constants import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees; antipodes are clamped instead of NaN."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (half_lon * half_lon)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def in_range(lat: Column, lon: Column) -> Column:
    """Both coordinates are on the globe; NaN and infinities are not."""
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def is_point(lat: Column, lon: Column) -> Column:
    """Both coordinates are present and finite."""
    limit = F.lit(float("inf"))
    return (F.abs(lat) < limit) & (F.abs(lon) < limit)
