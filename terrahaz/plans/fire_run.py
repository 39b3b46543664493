"""A fire ingest run: normalise, insert, notify."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fires import insert_new_fires
from ..operators.notices import wildfire_notifications
from ..sources.readers import fire_csv_normalize

STORED_FIRE = ("time_utc", "lat", "lon", "lat_round", "lon_round", "geom_wkt", "frp", "confidence",
               "satellite", "source", "raw_job_id")


def ingest_fires(raw: DataFrame, stored_fires: DataFrame, assets: DataFrame, stored_notices: DataFrame,
                 bbox: tuple[float, float, float, float], start: dt.date | str, end: dt.date | str,
                 source: str, job_id: str, now: dt.datetime | str) -> tuple[DataFrame, DataFrame]:
    """New fire rows and new notifications of one batch of detections.

    ``raw`` is text columns plus ``arrival``, the order the rows came in.
    """
    fires = fire_csv_normalize(raw, bbox, start, end, extra=("arrival",)).withColumn("source", F.lit(source))
    fresh = insert_new_fires(fires, stored_fires, "arrival", job_id).select(*STORED_FIRE)
    notices = wildfire_notifications(assets, stored_fires.unionByName(fresh), stored_notices, now)
    return fresh, notices
