"""Distances on the sphere and positions in space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _half_chord_squared(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
        * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    )


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance, two-argument arctangent form (stable near antipodes)."""
    a = _half_chord_squared(lat1, lon1, lat2, lon2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1e-12), 1 - a)))


def great_circle_km_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance, arcsine form used by the province model."""
    return 2 * EARTH_KM * F.asin(F.sqrt(_half_chord_squared(lat1, lon1, lat2, lon2)))


def space_axes(lat: Column, lon: Column) -> dict[str, Column]:
    """Position as kilometres along three fixed axes through the Earth's centre.

    Straight-line distance between two such positions grows with the
    great-circle distance, so cubes in this space can index points anywhere,
    poles and date line included.
    """
    return {
        "x": EARTH_KM * F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
        "y": EARTH_KM * F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
        "z": EARTH_KM * F.sin(F.radians(lat)),
    }


def wkt_point(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))
