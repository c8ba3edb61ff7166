"""Vectors and positions on the globe."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_MILES = 3958.8


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Null when either position is missing."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_MILES) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def coordinate_pair(text: Column) -> Column:
    """STRUCT<lat, lon> of a 'lat, lon' text, else null."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
    lat = F.regexp_extract(text, pattern, 1).try_cast("double")
    lon = F.regexp_extract(text, pattern, 2).try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def zip_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(\d{5})\b", 1), F.lit(""))
