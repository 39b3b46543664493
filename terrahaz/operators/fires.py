"""Fire detections: dedupe, incremental insert, distances to assets."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import instant_literal
from ..functions.geo import EARTH_KM, great_circle_km, great_circle_km_asin, space_axes
from ..functions.numbers import half_even
from ..session import joins_by_measure
from .features import keep_newest
from .lookup import stored_candidates
from .nearest import KILOMETRES, nearest_candidates, radius_pieces

AXES = ["x", "y", "z"]
FIRE_KEY = ["time_utc", "lat_round", "lon_round"]
FIRE_FEATURES = (
    "nearest_fire_distance_km_24h", "nearest_fire_distance_km_7d",
    "fires_within_10km_count_24h", "fires_within_10km_count_7d",
    "max_frp_within_20km_24h", "max_frp_within_20km_7d",
)
COUNT_KM, POWER_KM = 10.0, 20.0


def fire_batch_dedupe(fires: DataFrame, arrival: str) -> DataFrame:
    """One row per (time, rounded position): the last to arrive."""
    return keep_newest(fires, FIRE_KEY, [F.col(arrival).desc()])


def fires_anti(fires: DataFrame, stored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fires whose key is not stored yet.

    Of the store only rows on the batch's days that pass a filter of its keys
    meet the batch (``stored_candidates``, which runs a job over the batch).
    """
    keys = keys or ["source", *FIRE_KEY]
    return fires.join(stored_candidates(fires, stored, keys).select(*keys), keys, "left_anti")


def insert_new_fires(fires: DataFrame, stored: DataFrame, arrival: str, job_id: str) -> DataFrame:
    """Rows a batch adds to the store.

    The batch is persisted: its days, its filter of keys and the result read it.
    """
    batch = keep_newest(fires, ["source", *FIRE_KEY], [F.col(arrival).desc()]).persist()
    fresh = fires_anti(batch, stored)
    return fresh.withColumn("raw_job_id", F.lit(job_id)).drop(arrival)


def _chord(km: float) -> float:
    """Straight-line length of a great-circle distance."""
    return 2 * EARTH_KM * math.sin(km / (2 * EARTH_KM))


def _nearest_km(spots: DataFrame, located: DataFrame, group: list[str]) -> DataFrame:
    """Distance from every (group, position) to the nearest fire of the group."""
    placed = spots.select(*group, "lat", "lon", *[
        c.alias(f"q_{a}") for a, c in space_axes(F.col("lat"), F.col("lon")).items()])
    sites = located.select(*group, F.col("lat").alias("fire_lat"), F.col("lon").alias("fire_lon"), *AXES)
    km = great_circle_km(F.col("lat"), F.col("lon"), F.col("fire_lat"), F.col("fire_lon"))
    pairs = nearest_candidates(placed, sites, group, AXES, KILOMETRES)
    return pairs.groupBy(*group, "lat", "lon").agg(half_even(F.min(km), 3).alias("nearest_km"))


def _near_totals(spots: DataFrame, located: DataFrame, group: str, counts: list[str],
                 powers: list[str]) -> DataFrame:
    """Sums of ``counts`` within 10 km and maxima of ``powers`` within 20 km."""
    placed = spots.select(group, "lat", "lon", *[
        c.alias(f"q_{a}") for a, c in space_axes(F.col("lat"), F.col("lon")).items()])
    boxes, sites = radius_pieces(
        placed, located, [group], AXES, _chord(POWER_KM),
        [*[F.sum(c).alias(c) for c in counts], *[F.max(p).alias(p) for p in powers]])
    slack = 1e-9
    ring10, ring20 = _chord(COUNT_KM), _chord(POWER_KM)
    all_in_10 = F.col("far_km") <= ring10 * (1 - slack)
    none_in_10 = F.col("near_km") > ring10 * (1 + slack)
    all_in_20 = F.col("far_km") <= ring20 * (1 - slack)
    decided = all_in_10 | (none_in_10 & all_in_20)
    keys = [group, "lat", "lon"]
    whole = boxes.where(decided).select(
        *keys, *[F.when(all_in_10, F.col(c)).otherwise(0).alias(c) for c in counts], *powers)
    buckets = [f"b_{a}" for a in AXES]
    opened = boxes.where(~decided).select(*keys, *buckets).join(
        sites.withColumnsRenamed({"lat": "fire_lat", "lon": "fire_lon"}), [group, *buckets])
    km = great_circle_km(F.col("lat"), F.col("lon"), F.col("fire_lat"), F.col("fire_lon"))
    single = opened.withColumn("km", km).where(F.col("km") <= POWER_KM).select(
        *keys, *[F.when(F.col("km") <= COUNT_KM, F.col(c)).otherwise(0).alias(c) for c in counts], *powers)
    return whole.unionByName(single).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counts], *[half_even(F.max(p), 3).alias(p) for p in powers])


def asset_fire_features(requests: DataFrame, fires: DataFrame) -> DataFrame:
    """Six fire features for every (asset, window end) asked for.

    ``requests``: asset_id, lat, lon, window_end.  Windows reach back 24 hours
    and 7 days and include both ends.  Assets at one position are computed
    once, repeated detections at one position collapse.  Meant for few distinct
    moments; for windows that end with calendar days see ``daily_fire_features``.
    The collapsed fires are read several times and therefore persisted.
    Broadcasts go by measured sizes (``joins_by_measure``).
    """
    joins_by_measure(fires.sparkSession)
    windows = requests.select("window_end").distinct().withColumn("_day", F.to_date("window_end"))
    offered = fires.select("time_utc", "lat", "lon", "frp").withColumn(
        "_day", F.explode(F.sequence(F.to_date("time_utc"), F.date_add(F.to_date("time_utc"), 7))))
    inside = offered.join(windows, "_day").where(
        (F.col("time_utc") >= F.col("window_end") - F.expr("INTERVAL 7 DAYS"))
        & (F.col("time_utc") <= F.col("window_end")))
    today = F.col("time_utc") >= F.col("window_end") - F.expr("INTERVAL 24 HOURS")
    located = inside.groupBy("window_end", "lat", "lon").agg(
        F.count(F.when(today, 1)).alias("n24"), F.count(F.lit(1)).alias("n7"),
        F.max(F.when(today, F.col("frp"))).alias("frp24"), F.max("frp").alias("frp7"),
    ).withColumns(space_axes(F.col("lat"), F.col("lon"))).persist()
    spots = requests.select("window_end", "lat", "lon").distinct()
    spans = F.when(F.col("n24") > 0, F.array(F.lit("24h"), F.lit("7d"))).otherwise(F.array(F.lit("7d")))
    per_span = _nearest_km(
        spots.withColumn("span", F.explode(F.array(F.lit("24h"), F.lit("7d")))),
        located.withColumn("span", F.explode(spans)), ["window_end", "span"])
    keys = ["window_end", "lat", "lon"]
    nearest = per_span.groupBy(*keys).agg(
        F.min(F.when(F.col("span") == "24h", F.col("nearest_km"))).alias("near24"),
        F.min(F.when(F.col("span") == "7d", F.col("nearest_km"))).alias("near7"))
    totals = _near_totals(spots, located, "window_end", ["n24", "n7"], ["frp24", "frp7"])
    answers = spots.join(nearest, keys, "left").join(totals, keys, "left").select(
        *keys, F.col("near24").alias("nearest_fire_distance_km_24h"),
        F.col("near7").alias("nearest_fire_distance_km_7d"),
        F.coalesce("n24", F.lit(0)).alias("fires_within_10km_count_24h"),
        F.coalesce("n7", F.lit(0)).alias("fires_within_10km_count_7d"),
        F.col("frp24").alias("max_frp_within_20km_24h"), F.col("frp7").alias("max_frp_within_20km_7d"))
    return requests.join(answers, keys).select("asset_id", "lat", "lon", "window_end", *FIRE_FEATURES)


def spot_day_fires(spot_days: DataFrame, fires: DataFrame) -> DataFrame:
    """Fire aggregates per (position, calendar day).

    ``spot_days``: lat, lon, date, distinct.  Adds nearest_km, fires_10km,
    max_frp_20km, and ``edge_10km``: fires in the very last microsecond of the
    day before, which a window ending with this day still includes.  The fires,
    collapsed per day and position, are persisted: several joins read them.
    Broadcasts go by measured sizes (``joins_by_measure``).
    """
    joins_by_measure(fires.sparkSession)
    midnight = F.date_add(F.to_date("time_utc"), 1).cast("timestamp")
    at_edge = F.unix_micros(midnight) - F.unix_micros("time_utc") <= 1
    rows = fires.select("time_utc", "lat", "lon", "frp").withColumn("time_utc", F.col("time_utc").cast("timestamp"))
    days = F.when(at_edge, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    counted = rows.withColumn("_shift", F.explode(days)).withColumn("date", F.date_add(F.to_date("time_utc"), F.col("_shift")))
    # one row per calendar day: safe to broadcast
    wanted = F.broadcast(spot_days.select("date").distinct())
    located = (
        counted.join(wanted, "date", "left_semi").groupBy("date", "lat", "lon").agg(
            F.count(F.when(F.col("_shift") == 0, 1)).alias("fires_10km"),
            F.count(F.when(F.col("_shift") == 1, 1)).alias("edge_10km"), F.max("frp").alias("max_frp_20km"))
        .withColumns(space_axes(F.col("lat"), F.col("lon")))).persist()
    keys = ["date", "lat", "lon"]
    totals = _near_totals(spot_days, located, "date", ["fires_10km", "edge_10km"], ["max_frp_20km"])
    return spot_days.join(_nearest_km(spot_days, located, ["date"]), keys, "left").join(totals, keys, "left").fillna(
        0, ["fires_10km", "edge_10km"])


def daily_fire_features(asset_days: DataFrame, fires: DataFrame) -> DataFrame:
    """Six fire features per (asset, day); windows end with the day.

    ``asset_days``: asset_id, lat, lon, date.  Every day is searched once per
    position and the 7-day values are a range window over the days, instead of
    searching each overlapping week anew.  The searched days are persisted.
    """
    back = F.explode(F.sequence(F.lit(0), F.lit(6)))
    spot_days = (
        asset_days.select("lat", "lon", "date").distinct().select("*", back.alias("_back"))
        .groupBy("lat", "lon", F.date_sub("date", F.col("_back")).alias("date"))
        .agg(F.max(F.col("_back") == 0).alias("_asked"))).persist()
    asked = spot_days.select("lat", "lon", "date", "_asked")
    found = spot_day_fires(spot_days.select("lat", "lon", "date"), fires)
    windows = fire_windows(found.join(asked, ["lat", "lon", "date"]), ["lat", "lon"], ["_asked"]).where("_asked")
    return asset_days.join(windows.drop("_asked"), ["lat", "lon", "date"]).select(
        "asset_id", "lat", "lon", "date", *FIRE_FEATURES)


def spots_near(spots: DataFrame, fires: DataFrame, km: float, totals: list[Column]) -> DataFrame:
    """Positions (lat, lon) with a box of fires within ``km``, with ``totals`` over those boxes.

    No position with a fire that near is missed; some may only have one a little farther.
    """
    placed = spots.select("lat", "lon").distinct().withColumns(
        {f"q_{a}": c for a, c in space_axes(F.col("lat"), F.col("lon")).items()})
    located = fires.withColumns(space_axes(F.col("lat"), F.col("lon")))
    names = [f"total_{i}" for i in range(len(totals))]
    boxes, _ = radius_pieces(placed, located, [], AXES, _chord(km), [t.alias(n) for t, n in zip(totals, names)])
    return boxes.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("boxes"), *[F.min(n).alias(n) for n in names])


def requests_at(assets: DataFrame, now: dt.datetime | str) -> DataFrame:
    return assets.withColumn("window_end", instant_literal(now))


def fire_windows(daily: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """Day aggregates to 24-hour and 7-day values.

    ``daily``: key, date, nearest_km, fires_10km, edge_10km, max_frp_20km.  The
    range frame counts calendar days, so missing days do not stretch it.
    """
    by_day = Window.partitionBy(*key).orderBy(F.unix_date("date"))
    week, first = by_day.rangeBetween(-6, 0), by_day.rangeBetween(-6, -6)
    return daily.select(
        *key, "date", *(keep or []),
        F.col("nearest_km").alias("nearest_fire_distance_km_24h"),
        F.min("nearest_km").over(week).alias("nearest_fire_distance_km_7d"),
        (F.col("fires_10km") + F.col("edge_10km")).alias("fires_within_10km_count_24h"),
        (F.sum("fires_10km").over(week) + F.coalesce(F.sum("edge_10km").over(first), F.lit(0)))
        .alias("fires_within_10km_count_7d"),
        F.col("max_frp_20km").alias("max_frp_within_20km_24h"),
        F.max("max_frp_20km").over(week).alias("max_frp_within_20km_7d"))


def asset_wildfire_view(features: DataFrame, window: str) -> DataFrame:
    """The 24-hour or the 7-day triple."""
    span = "24h" if window == "24h" else "7d"
    return features.select(
        "asset_id",
        F.col(f"nearest_fire_distance_km_{span}").alias("nearest_fire_distance_km"),
        F.col(f"fires_within_10km_count_{span}").alias("fires_within_10km_count"),
        F.col(f"max_frp_within_20km_{span}").alias("max_frp_within_20km"))


def province_hotspot_count(provinces: DataFrame, fires: DataFrame, radius_km: float = 75.0) -> DataFrame:
    """Fires within the radius of each province centre; provinces without any are left out."""
    centres = provinces.select("id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).withColumns(
        {f"q_{a}": c for a, c in space_axes(F.col("p_lat"), F.col("p_lng")).items()})
    sites = fires.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).withColumns(
        space_axes(F.col("lat"), F.col("lon")))
    ring = _chord(radius_km)
    boxes, keyed = radius_pieces(centres, sites, [], AXES, ring, [F.sum("n").alias("n")])
    inside = F.col("far_km") <= ring * (1 - 1e-9)
    opened = boxes.where(~inside).drop("n", "near_km", "far_km").join(
        keyed, [f"b_{a}" for a in AXES])
    km = great_circle_km_asin(F.col("p_lat"), F.col("p_lng"), F.col("lat"), F.col("lon"))
    return (
        boxes.where(inside).select("id", "n")
        .unionByName(opened.where(km <= radius_km).select("id", "n"))
        .groupBy("id").agg(F.sum("n").alias("hits"))
    )
