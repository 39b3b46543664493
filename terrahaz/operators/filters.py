"""Row filters.  All bounds are inclusive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_literal, instant_literal

# Precipitation may be delivered as one field or as two parts.
PRECIP_PARTS = ("large_scale_precipitation", "convective_precipitation")
PRECIP_SOURCES = ("total_precipitation", *PRECIP_PARTS)


def filter_bbox(df: DataFrame, north: float, west: float, south: float, east: float,
                lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Rows inside the box; a box given the wrong way round holds nothing."""
    return df.where(F.col(lat).between(south, north) & F.col(lng).between(west, east))


def filter_grid_bbox(df: DataFrame, north: float, west: float, south: float, east: float,
                     lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Grid cells between the two corners, whichever way round they are given."""
    low_lat, high_lat = sorted((south, north))
    low_lng, high_lng = sorted((west, east))
    return df.where(F.col(lat).between(low_lat, high_lat) & F.col(lng).between(low_lng, high_lng))


def filter_date_range(df: DataFrame, start: dt.date | str, end: dt.date | str,
                      date: str = "date") -> DataFrame:
    return df.where(F.col(date).between(day_literal(start), day_literal(end)))


def scan_fires_range(fires: DataFrame, start: dt.datetime | str, end: dt.datetime | str) -> DataFrame:
    return fires.where(F.col("time_utc").between(instant_literal(start), instant_literal(end)))


def filter_interval_overlap(df: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    return df.where((F.col("start_date") <= day_literal(end)) & (F.col("end_date") >= day_literal(start)))


def accepted_variables(required: list[str]) -> list[str]:
    """Required variables plus every form precipitation may come in."""
    wanted = set(required)
    if "total_precipitation" in wanted:
        wanted.update(PRECIP_SOURCES)
    return sorted(wanted)


def variable_in_list(objects: DataFrame, required: list[str]) -> DataFrame:
    return objects.where(F.col("variable").isin(accepted_variables(required)))


def normalize_severity(df: DataFrame) -> DataFrame:
    lowered = F.lower("severity")
    return df.withColumn(
        "severity", F.when(lowered.isin("low", "medium", "high"), lowered).otherwise("low"))


def severity_filter(notifications: DataFrame, severity: str = "all") -> DataFrame:
    return notifications if severity == "all" else notifications.where(F.col("severity") == severity)


def search_filter(df: DataFrame, text: str, fields: list[str], band: str = "all",
                  band_field: str = "band") -> DataFrame:
    """Case-insensitive substring on any of the fields, and an exact band."""
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.lower(F.col(field)).contains(text.lower())
    return df.where(hit) if band == "all" else df.where(hit & (F.col(band_field) == band))


def filter_perils(scores: DataFrame, perils: list[str]) -> DataFrame:
    return scores.where(F.col("peril").isin(perils))


def tag_lineage(df: DataFrame, source: str, run_id: str, now: dt.datetime | str) -> DataFrame:
    return df.withColumns({
        "source": F.lit(source),
        "run_id": F.lit(run_id),
        "ingested_at": instant_literal(now),
    })


def newest_first(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]
