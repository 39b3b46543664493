"""Stream jobs, run to the end of the supplied events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.session import shared_folder
from terrahaz.streaming import jobs

from .common import plain
from .views import STEPS, Tables


def _events(t: Tables) -> DataFrame:
    """The events file as a stream; its times carry no zone, so they are read as UTC."""
    files = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def fire_stream(t: Tables, copies: int = 1) -> DataFrame:
    """Detections; asked for, each arrives several times."""
    repeated = _events(t).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    lat = F.lit(36.0) + ((F.col("event_id") * 7) % 600) / 100.0
    lon = F.lit(26.0) + ((F.col("event_id") * 13) % 1900) / 100.0
    return repeated.select(
        "event_id", F.date_trunc("minute", "ts").alias("time_utc"), lat.alias("lat"), lon.alias("lon"),
        lat.alias("lat_round"), lon.alias("lon_round"), F.col("value").alias("frp"),
        F.concat(F.lit("S"), (F.col("event_id") % 2).cast("string")).alias("source"))


def hourly_stream(t: Tables) -> DataFrame:
    cents = F.round(F.col("value") * 100.0).cast("bigint")
    kind, user = F.col("event_type"), F.col("user_id") % 4
    variable = (F.when(kind == "view", "2m_temperature").when(kind == "click", "total_precipitation")
                .when(kind == "purchase", "10m_u_component_of_wind").when(kind == "signup", "10m_v_component_of_wind")
                .otherwise("volumetric_soil_water_layer_1"))
    value = (F.when(kind == "view", 273.0 + cents % 40).when(kind == "click", (cents % 64) / 16384.0)
             .when(kind == "purchase", cents % 41 - 20.0).when(kind == "signup", cents % 37 - 18.0).otherwise((cents % 64) / 128.0))
    return _events(t).select(
        F.col("ts").alias("time"), F.concat(F.lit("p"), user.cast("string")).alias("point_id"),
        (36.0 + user * 0.25).alias("lat"), (26.0 + user * 0.5).alias("lng"), variable.alias("variable"),
        value.alias("value"), F.col("event_id").alias("tie"))


def _stored(t: Tables, stream: DataFrame, handler, name: str) -> DataFrame:
    """The store a handler makes of the stream."""
    base = shared_folder(t.spark, name)
    jobs.drain_batches(stream, handler(f"{base}/store"), f"{base}/checkpoint")
    return jobs.stored_rows(t.spark, f"{base}/store")


def _alerts(t: Tables) -> DataFrame:
    base = shared_folder(t.spark, "fire-alerts")
    handler = jobs.fire_alert_handler(t.v_assets, f"{base}/fires", f"{base}/notices", f"{base}/watched")
    jobs.drain_batches(fire_stream(t, 3), handler, f"{base}/checkpoint")
    return jobs.notice_table(t.spark, f"{base}/notices").read().select("portfolio_id", "asset_id", "severity", "dedup_key")


STEPS["x_alert_moment"] = """
    select portfolio_id, asset_id, min(km) filter (where time_utc >= now_at - interval 24 hours) as n24, min(km) as n7,
           count(*) filter (where km <= 10 and time_utc >= now_at - interval 24 hours) as c24,
           count(*) filter (where km <= 10) as c7, max(now_at) as now_at
    from (select a.portfolio_id, a.asset_id, f.time_utc, n.now_at,
                 2 * 6371E0 * asin(sqrt(pow(sin(radians(f.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(f.lat))
                                        * pow(sin(radians(f.lon - a.lon) / 2), 2))) as km
          from v_assets a cross join (select max(time_utc) as now_at from v_fires) n
          join v_fires f on f.time_utc >= n.now_at - interval 7 days) t
    group by portfolio_id, asset_id"""

QUERIES = {
    "stream_fires": lambda t: plain(_stored(t, fire_stream(t, 3), jobs.fire_handler, "fires").select(
        "event_id", "time_utc", "lat", "lon", "frp", "source")),
    "stream_fire_counts": lambda t: plain(jobs.fire_counts(_stored(t, fire_stream(t, 3), jobs.fire_count_handler, "fire-counts"))),
    "stream_daily_features": lambda t: plain(jobs.daily_features(_stored(t, hourly_stream(t), jobs.hourly_handler, "hours")),
                                             {c: 9 for c in ("temp_mean", "precip_sum", "wind_max", "soil_moisture_mean")}),
    "stream_fire_alerts": _alerts,
}

ORACLES = {
    "stream_fires": "select event_id, cast(time_utc as varchar) as time_utc, lat, lon, frp, source from v_fires",
    "stream_fire_counts": """
        with w as (select d as window_start, d + interval 7 days as window_end
                   from (select unnest(generate_series(cast(date_trunc('day', min(time_utc)) as timestamp) - interval 6 days,
                                                       cast(date_trunc('day', max(time_utc)) as timestamp), interval 1 day)) as d
                         from v_fires) g)
        select cast(window_start as varchar) as window_start, cast(window_end as varchar) as window_end, source,
               count(*) as n, max(frp) as max_frp
        from w join v_fires f on f.time_utc >= window_start and f.time_utc < window_end
        group by window_start, window_end, source""",
    "stream_daily_features": """
        select cast(cast(time as date) as varchar) as date, point_id, lat, lng, round_even(avg(t), 9) as temp_mean, max(t) as temp_max,
               round_even(coalesce(sum(p), 0), 9) as precip_sum, round_even(max(sqrt(u * u + v * v)), 9) as wind_max,
               round_even(avg(s), 9) as soil_moisture_mean
        from x_hourly_wide
        group by cast(time as date), point_id, lat, lng""",
    "stream_fire_alerts": """
        select portfolio_id, asset_id, severity,
               concat_ws(':', portfolio_id, asset_id, 'wildfire_proximity', severity, strftime(now_at, '%Y-%m-%d')) as dedup_key
        from (select *, case when n24 < 5 or c24 >= 1 then 'high' when n7 < 15 or c7 >= 3 then 'medium' end as severity
              from x_alert_moment) t where severity is not null""",
}
