"""Great-circle arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MAX_PLAUSIBLE_KMH = 900.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points, null if any coordinate is; 0 where both differ by less than 1e-9 degrees."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    a = F.when(a > 1, 1.0).otherwise(a)  # not least(), which passes over nulls
    d = EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    return F.when((F.abs(lat2 - lat1) < 1e-9) & (F.abs(lon2 - lon1) < 1e-9), 0.0).otherwise(d)


def speed(km: Column, hours: Column) -> Column:
    """km/h; 0 for spans of no length."""
    return F.when(hours <= 1e-4, 0.0).otherwise(km / hours)


def implausible(km: Column, hours: Column) -> Column:
    return (km > 100) & (hours > 0) & (speed(km, hours) > MAX_PLAUSIBLE_KMH)


def valid(lat: Column, lon: Column) -> Column:
    """Finite and on the globe; null is not valid."""
    ok = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok, F.lit(False))


def missing(lat: Column, lon: Column) -> Column:
    return lat.isNull() | lon.isNull() | ((F.abs(lat) < 1e-4) & (F.abs(lon) < 1e-4))


HAVERSINE_SQL = (
    "CASE WHEN abs({b}lat - {a}lat) < 1e-9 AND abs({b}lon - {a}lon) < 1e-9 THEN 0.0 ELSE 6371.0 * 2 * atan2(sqrt(least(1.0, "
    "pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))), "
    "sqrt(1 - least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))) END"
)
