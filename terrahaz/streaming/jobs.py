"""Stream jobs.

Batch handlers add each micro-batch to a versioned table and ``drain_batches``
runs one until its source has nothing new.  Nothing is dropped for being late:
tables are kept by event day and hold detections or partial aggregates that are
merged when read, so a late row corrects its day or window.  A day is read from
two sets of files at most: what it was when last written whole, and one batch
since.  A batch replayed after a failure changes nothing.  Checkpoints and
tables live in folders the caller names, on storage all executors reach.
"""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import instant_literal
from ..operators.features import HOURLY_VARIABLES, PRECIP, SOIL, TEMPERATURE, WIND_U, WIND_V, keep_newest, wind_speed
from ..operators.fires import FIRE_KEY, POWER_KM, fires_anti, spots_near
from ..operators.notices import notifications_anti, wildfire_candidates
from ..sources.sinks import with_bucket
from ..sources.versions import VersionedTable

WINDOW_DAYS = 7


def day_table(spark, store: str, schema: T.StructType, order: tuple[str, ...] = ()) -> VersionedTable:
    return VersionedTable(spark, store, schema, ["day"], order)


def stored_rows(spark, store: str) -> DataFrame:
    """The rows of a stream's table."""
    return day_table(spark, store, VersionedTable.schema_of(spark, store)).read()


def store_fires(batch: DataFrame, batch_id: int, store: str) -> VersionedTable:
    """Adds the detections that are not stored yet, whatever their age; of several with one key the last."""
    # exact positions serve where rounded ones are not given
    key = [c for c in ("source", *FIRE_KEY) if c in batch.columns]
    key += [c for c in ("lat", "lon") if f"{c}_round" not in key]
    last = [F.col(c).desc() for c in (["arrival"] if "arrival" in batch.columns else []) + [c for c in batch.columns if c != "arrival"]]
    arrived = keep_newest(batch, key, last).withColumn("day", F.to_date("time_utc"))
    table = day_table(batch.sparkSession, store, arrived.schema, ("time_utc",))
    arrived = arrived.persist()  # asked for its days, its keys and its rows
    try:
        table.add(fires_anti(arrived, table.read(table.touched(arrived)), key) if table.version() else arrived, batch_id)
    finally:
        arrived.unpersist()
    return table


def fire_handler(store: str) -> Callable[[DataFrame, int], None]:
    def handle(batch: DataFrame, batch_id: int) -> None:
        store_fires(batch, batch_id, store)

    return handle


def fire_count_handler(store: str) -> Callable[[DataFrame, int], None]:
    """Counts are made of the stored detections, so that one delivered again counts once."""
    return fire_handler(store)


def fire_counts(stored: DataFrame) -> DataFrame:
    """Stored detections per source in 7-day windows that start every day, open ones included."""
    starts = F.sequence(F.date_sub("day", WINDOW_DAYS - 1), F.col("day"))
    return (
        stored.groupBy("day", "source").agg(F.count(F.lit(1)).alias("n"), F.max("frp").alias("max_frp"))
        .withColumn("first", F.explode(starts)).groupBy("first", "source")
        .agg(F.sum("n").alias("n"), F.max("max_frp").alias("max_frp"))
        .select(F.col("first").cast("timestamp").alias("window_start"),
                F.date_add("first", WINDOW_DAYS).cast("timestamp").alias("window_end"), "source", "n", "max_frp"))


HOUR = ["hour", "point_id", "lat", "lng"]


def _merged_hours(stored: DataFrame) -> DataFrame:
    return stored.groupBy("day", *HOUR).agg(*[F.min(v).alias(v) for v in HOURLY_VARIABLES])


def hourly_handler(store: str) -> Callable[[DataFrame, int], None]:
    """Stores a batch's reading of every point, hour and variable: the one of the least tie."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        first = [F.min(F.when(F.col("variable") == v, F.struct("tie", "value"))).alias(v) for v in HOURLY_VARIABLES]
        hours = batch.groupBy(F.date_trunc("hour", "time").alias("hour"), "point_id", "lat", "lng").agg(*first)
        hours = hours.withColumn("day", F.to_date("hour"))
        day_table(batch.sparkSession, store, hours.schema, ("point_id", "hour")).add(
            hours, batch_id, combine=lambda rows: _merged_hours(rows).select(*hours.columns))

    return handle


def daily_features(stored: DataFrame) -> DataFrame:
    """Stored hours to daily features.

    Units must be settled at ingest: a stream has no whole file to test.
    """
    hourly = (
        _merged_hours(stored).select("day", *HOUR, *[F.col(v)["value"].alias(v) for v in HOURLY_VARIABLES])
        .withColumn("wind_speed", wind_speed(F.col(WIND_U), F.col(WIND_V))))
    return (
        hourly.groupBy("day", "point_id", "lat", "lng")
        .agg(F.avg(TEMPERATURE).alias("temp_mean"), F.max(TEMPERATURE).alias("temp_max"),
             F.coalesce(F.sum(PRECIP), F.lit(0.0)).alias("precip_sum"), F.max("wind_speed").alias("wind_max"),
             F.avg(SOIL).alias("soil_moisture_mean"))
        .withColumnRenamed("day", "date"))


_TEXT, _TIME = T.StringType(), T.TimestampType()
NOTICE_SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("id", _TEXT), ("portfolio_id", _TEXT), ("asset_id", _TEXT), ("type", _TEXT), ("severity", _TEXT), ("dedup_key", _TEXT),
    ("created_at", _TIME), ("acknowledged_at", _TIME), ("day", T.DateType()))])
WATCH_SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("portfolio_id", _TEXT), ("asset_id", _TEXT), ("changes_at", _TIME), ("bucket_no", T.IntegerType()))])
ASSET = ["portfolio_id", "asset_id"]


def notice_table(spark, store: str) -> VersionedTable:
    return day_table(spark, store, NOTICE_SCHEMA)


def watch_table(spark, store: str) -> VersionedTable:
    """Assets with fires nearby and the moment when their state may change without new ones."""
    return VersionedTable(spark, store, WATCH_SCHEMA, ["bucket_no"])


def _changes(assets: DataFrame, recent: DataFrame, moment: dt.datetime) -> DataFrame:
    """ASSET, changes_at: when the first nearby fire leaves a window, at midnight at the latest
    (notices are due anew every day)."""
    now = instant_literal(str(moment))
    leaves = F.when(F.col("time_utc") + F.expr("INTERVAL 24 HOURS") >= now, F.col("time_utc") + F.expr("INTERVAL 24 HOURS")).otherwise(
        F.col("time_utc") + F.expr(f"INTERVAL {WINDOW_DAYS} DAYS"))
    near = spots_near(assets, recent.select("lat", "lon", leaves.alias("leaves")), POWER_KM, [F.min("leaves")])
    midnight = F.date_trunc("day", now) + F.expr("INTERVAL 1 DAY")
    return assets.join(near, ["lat", "lon"]).select(*ASSET, F.least(F.col("total_0"), midnight).alias("changes_at"))


def fire_alert_handler(assets: DataFrame, fire_store: str, notice_store: str, watch_store: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: store the fires, then raise notifications as of the newest
    detection so far.

    An asset's state changes only by a new fire nearby or when one leaves a
    window.  So only assets near the batch's fires and those whose entry in the
    watch table has run out are searched; of the notices two days are read.  The
    watch table is written last: a batch that is replayed finds it as it was.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        fires = store_fires(batch, batch_id, fire_store)
        newest = max(h[0] for h in fires.held() if h[0] is not None)
        moment = fires.read(F.col("day") == F.lit(newest)).agg(F.max("time_utc").alias("t")).first()["t"]
        now = instant_literal(str(moment))
        first = now - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
        # the days are named by the table's pointer, so older ones are not opened
        recent = fires.read(F.col("day") >= F.lit((moment - dt.timedelta(days=WINDOW_DAYS)).date())).where(F.col("time_utc") >= first)
        watch, notices = watch_table(spark, watch_store), notice_table(spark, notice_store)
        due = watch.read().where(F.col("changes_at") <= now).select(*ASSET)
        touched = assets.join(spots_near(assets, batch.select("lat", "lon"), POWER_KM, []), ["lat", "lon"], "left_semi").select(*ASSET)
        searched = assets.join(due.unionByName(touched).distinct(), ASSET, "left_semi").persist()
        try:
            lately = notices.read(F.col("day") >= F.lit((moment - dt.timedelta(days=1)).date()))
            fresh = notifications_anti(wildfire_candidates(searched, recent, str(moment)), lately, str(moment))
            notices.add(fresh.withColumn("day", F.to_date("created_at")).select(*NOTICE_SCHEMA.names), batch_id)
            seen = with_bucket(searched.select(*ASSET), *ASSET)
            entries = with_bucket(_changes(searched, recent, moment), *ASSET).select(*WATCH_SCHEMA.names)
            watch.merge(seen, lambda stored, new: stored.join(new, ASSET, "left_anti").unionByName(entries))
        finally:
            searched.unpersist()

    return handle


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    query.awaitTermination()
