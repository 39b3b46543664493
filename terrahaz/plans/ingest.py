"""Gridded hourly readings to stored daily features."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import (
    HOURLY_VARIABLES, LARGE_SCALE, CONVECTIVE, hourly_point_sample, hourly_to_daily, pivot_variables,
    precip_from_components, rename_aliases)
from ..operators.filters import filter_grid_bbox, tag_lineage
from ..sources.sinks import sink_features_month


def point_features(grid: DataFrame, points: DataFrame, source: str, run_id: str, now: dt.datetime | str,
                   bbox: tuple[float, float, float, float] | None = None,
                   total_delivered: bool = True) -> DataFrame:
    """All months of a long grid table to daily point features in one job.

    Months are the units of the unit rule.  ``total_delivered`` says whether the
    total precipitation field exists or has to be summed from its parts.
    """
    grid = rename_aliases(grid)
    if bbox is not None:
        grid = filter_grid_bbox(grid, *bbox)
    hourly = hourly_point_sample(grid, points)
    names = [v for v in HOURLY_VARIABLES if total_delivered or v != "total_precipitation"]
    if not total_delivered:
        names += [LARGE_SCALE, CONVECTIVE]
    wide = precip_from_components(pivot_variables(hourly, names))
    wide = wide.withColumn("batch", F.date_format("time", "yyyy-MM"))
    return tag_lineage(hourly_to_daily(wide, "batch"), source, run_id, now)


def ingest_points(grid: DataFrame, points: DataFrame, path: str, source: str, run_id: str,
                  now: dt.datetime | str) -> None:
    sink_features_month(point_features(grid, points, source, run_id, now), path)
