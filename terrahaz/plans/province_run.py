"""The province pipeline: scores, alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..operators.fires import province_hotspot_count
from ..operators.province import HOTSPOT_RADIUS_KM, province_alerts, province_asof_scores


def run_provinces(provinces: DataFrame, rain: DataFrame, fires: DataFrame, today: dt.date | str,
                  now: dt.datetime | str, days: int = 30,
                  radius_km: int = HOTSPOT_RADIUS_KM) -> tuple[DataFrame, DataFrame]:
    """Scores of the last ``days`` days, and the alerts of today."""
    scores = province_asof_scores(rain, today, days)
    hits = province_hotspot_count(provinces, fires, radius_km)
    return scores, province_alerts(provinces, scores, hits, today, now, radius_km)
