"""Proximity notifications."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import instant_literal
from .fires import FIRE_FEATURES, asset_fire_features, requests_at

NOTICE_TYPE = "wildfire_proximity"


def proximity_severity() -> Column:
    near24, near7 = F.col("nearest_fire_distance_km_24h"), F.col("nearest_fire_distance_km_7d")
    high = F.coalesce(near24 < 5.0, F.lit(False)) | (F.col("fires_within_10km_count_24h") >= 1)
    medium = F.coalesce(near7 < 15.0, F.lit(False)) | (F.col("fires_within_10km_count_7d") >= 3)
    return F.when(high, "high").when(medium, "medium")


def notifications_anti(candidates: DataFrame, stored: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Candidates whose key was not already raised within the last day."""
    recent = stored.where(
        (F.col("type") == NOTICE_TYPE)
        & (F.col("created_at") >= instant_literal(now) - F.expr("INTERVAL 1 DAY")))
    return candidates.join(recent.select("dedup_key"), "dedup_key", "left_anti")


def wildfire_candidates(assets: DataFrame, fires: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Every asset with a reason to be warned.  ``assets``: portfolio_id, asset_id, lat, lon."""
    moment = instant_literal(now)
    recent = fires.where(F.col("time_utc").between(moment - F.expr("INTERVAL 7 DAYS"), moment))
    owned = assets.withColumn("asset_id", F.struct("portfolio_id", "asset_id"))
    features = asset_fire_features(requests_at(owned.select("asset_id", "lat", "lon"), now), recent)
    rated = features.withColumn("severity", proximity_severity()).where(F.col("severity").isNotNull())
    key = F.concat_ws(":", "asset_id.portfolio_id", "asset_id.asset_id", F.lit(NOTICE_TYPE), "severity",
                      F.date_format(moment, "yyyy-MM-dd"))
    return rated.select(
        F.concat(F.lit("ntf_"), F.substring(F.sha2(key, 256), 1, 20)).alias("id"),
        F.col("asset_id.portfolio_id").alias("portfolio_id"), F.col("asset_id.asset_id").alias("asset_id"),
        F.lit(NOTICE_TYPE).alias("type"), "severity", F.struct(*FIRE_FEATURES).alias("payload"),
        key.alias("dedup_key"), moment.alias("created_at"), F.lit(None).cast("timestamp").alias("acknowledged_at"))


def wildfire_notifications(assets: DataFrame, fires: DataFrame, stored: DataFrame,
                           now: dt.datetime | str) -> DataFrame:
    """New notifications of this moment."""
    return notifications_anti(wildfire_candidates(assets, fires, now), stored, now)


def ack_notification(notifications: DataFrame, acked: DataFrame, now: dt.datetime | str) -> DataFrame:
    """The table after acknowledging the ids in ``acked``; the first time stays."""
    marks = acked.select("id").distinct().withColumn("_ack", F.lit(True))
    return notifications.join(marks, "id", "left").withColumn(
        "acknowledged_at",
        F.when(F.col("_ack"), F.coalesce("acknowledged_at", instant_literal(now)))
        .otherwise(F.col("acknowledged_at"))).drop("_ack")


def notification_order(notifications: DataFrame, portfolio_id: str | None = None) -> DataFrame:
    chosen = notifications if portfolio_id is None else notifications.where(F.col("portfolio_id") == portfolio_id)
    return chosen.orderBy(F.col("created_at").desc(), "id")


def parse_payload(notifications: DataFrame) -> DataFrame:
    """Payload text to JSON; text that is no JSON becomes ``{"raw": text}``."""
    parsed = F.try_parse_json("payload")
    wrapped = F.parse_json(F.to_json(F.struct(F.col("payload").alias("raw"))))
    return notifications.withColumn(
        "payload",
        F.when(F.col("payload").isNull() | (F.col("payload") == ""), F.parse_json(F.lit("{}")))
        .otherwise(F.coalesce(parsed, wrapped)))


def severity_counts(notifications: DataFrame) -> DataFrame:
    return notifications.agg(*[
        F.count(F.when(F.col("severity") == s, 1)).alias(f"{s}_count") for s in ("high", "medium", "low")])


def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.agg(F.count(F.when(F.col("acknowledged_at").isNull(), 1)).alias("unread"))
