"""Fire detections, distances, notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.functions.dates import end_of_day
from terrahaz.functions.numbers import PERILS
from terrahaz.operators import filters as fl
from terrahaz.operators import fires as fi
from terrahaz.operators import ledgers as lg
from terrahaz.operators import notices as nt
from terrahaz.operators import perils as pe
from terrahaz.plans.fire_run import ingest_fires
from terrahaz.plans.scoring import batch_scores
from terrahaz.sources import readers, sinks

from . import climate
from .climate import _band_sql
from .common import FIRE_NOW, FIRE_DAYS, SCORING, VERSION, plain, stored
from .views import STEPS, Tables

BBOX = (41.5, 27.0, 36.5, 44.0)
JANUARY = ("2024-01-01", "2024-01-31")
NOW = "2024-01-20 12:30:00"
FEATURES = list(fi.FIRE_FEATURES)
# fires moved back so that they meet the days the weather is scored for
SHIFT_DAYS = 8766


def _asset_days(t: Tables, start: str, end: str) -> DataFrame:
    # days are listed after the join: a row per asset travels, not one per asset and day
    spots = t.v_assets.select("asset_id", "lat", "lon").join(t.v_assets.select("asset_id"), "asset_id")
    return spots.withColumn("date", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))


def day_features(t: Tables) -> DataFrame:
    return fi.daily_fire_features(_asset_days(t, *FIRE_DAYS), t.v_fires).select("asset_id", "date", *FEATURES)


def features_by_moment(t: Tables) -> DataFrame:
    """The same days asked for as moments."""
    asked = _asset_days(t, *FIRE_DAYS).withColumn("window_end", end_of_day(F.col("date"))).drop("date")
    return fi.asset_fire_features(asked, t.v_fires).select(
        "asset_id", F.to_date("window_end").alias("date"), *FEATURES)


def month_windows(t: Tables) -> DataFrame:
    spots = t.v_assets.select("asset_id", "lat", "lon")
    days = _asset_days(t, *FIRE_DAYS).select("lat", "lon", "date").distinct()
    daily = spots.join(fi.spot_day_fires(days, t.v_fires), ["lat", "lon"])
    return fi.fire_windows(daily, ["asset_id"])


def moment_features(t: Tables) -> DataFrame:
    return fi.asset_fire_features(fi.requests_at(t.v_assets.select("asset_id", "lat", "lon"), NOW), t.v_fires)


def normalized(t: Tables) -> DataFrame:
    return readers.fire_csv_normalize(t.v_fire_text, BBOX, "2024-01-03", "2024-01-28", extra=("arrival",))


def _stored_fires(t: Tables) -> DataFrame:
    return t.v_fire_copies.where("frp > 50").select("source", "time_utc", "lat_round", "lon_round")


def _candidates(t: Tables) -> DataFrame:
    return t.v_notifications.select("id", "portfolio_id", "asset_id", F.concat(
        F.lit("key-"), F.substring("asset_id", 2, 9), F.lit("-2024-01-20")).alias("dedup_key"))


def _batch_with_fires(t: Tables) -> DataFrame:
    fires = t.v_fires.withColumn("time_utc", F.col("time_utc") - F.make_dt_interval(F.lit(SHIFT_DAYS)))
    scores = batch_scores(t.v_features, t.v_assets, climate.monthly(t), None, *SCORING, VERSION, list(PERILS), fires,
                          separator="; ")
    return plain(scores.select("asset_id", "date", "peril", "score", "band", "drivers"))


def _ingest(t: Tables) -> DataFrame:
    fresh, _ = ingest_fires(
        t.v_fire_text, t.spark.createDataFrame([], _EMPTY_FIRES), t.v_assets, t.v_notifications.drop("payload"),
        BBOX, "2024-01-03", "2024-01-28", "VIIRS_SNPP_NRT", "job-1", NOW)
    return plain(fresh)


def _acks(t: Tables) -> DataFrame:
    notices = t.v_notifications.withColumns({
        "acknowledged_at": F.col("acknowledged_at").cast("timestamp"), "day": F.to_date("created_at")})
    table = stored(t.spark, "notices", notices, "day")
    sinks.store_acks(table, notices.where("severity = 'HIGH'"), NOW)
    return plain(table.read().select("id", "acknowledged_at"))


_EMPTY_FIRES = (
    "time_utc timestamp, lat double, lon double, lat_round double, lon_round double, geom_wkt string, frp double, "
    "confidence string, satellite string, source string, raw_job_id string")

_KM = ("2 * 6371E0 * atan2(sqrt({a}), sqrt(greatest(1E-12, 1 - {a})))").format(
    a="(pow(sin(radians(f.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lon - a.lon) / 2), 2))")

# Every pair of request and fire in reach of its window: the brute-force form.
_BRUTE = """
    select {keys}, round_even(min(km) filter (where d1), 3) as nearest_fire_distance_km_24h,
           round_even(min(km), 3) as nearest_fire_distance_km_7d,
           count(*) filter (where km <= 10 and d1) as fires_within_10km_count_24h,
           count(*) filter (where km <= 10) as fires_within_10km_count_7d,
           round_even(max(frp) filter (where km <= 20 and d1), 3) as max_frp_within_20km_24h,
           round_even(max(frp) filter (where km <= 20), 3) as max_frp_within_20km_7d
    from (select {keys}, """ + _KM + """ as km, f.frp, f.time_utc >= w.stop - interval 24 hours as d1
          from v_assets a cross join ({windows}) w join v_fires f
            on f.time_utc between w.stop - interval 7 days and w.stop) t
    group by all"""

STEPS.update({
    "x_fire_days": _BRUTE.format(keys="asset_id, date", windows=f"""
        select cast(d as date) as date, d + interval 1 day - interval 1 microsecond as stop
        from generate_series(timestamp '{FIRE_DAYS[0]}', timestamp '{FIRE_DAYS[1]}', interval 1 day) g(d)"""),
    "x_moment": _BRUTE.format(keys="portfolio_id, asset_id", windows=f"select timestamp '{NOW}' as stop"),
    "x_month": _BRUTE.format(keys="asset_id, date", windows="""
        select cast(d as date) as date, d + interval 1 day - interval 1 microsecond as stop
        from generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day) g(d)"""),
    "x_severity": """
        select *, case when nearest_fire_distance_km_24h < 5 or fires_within_10km_count_24h >= 1 then 'high'
                       when nearest_fire_distance_km_7d < 15 or fires_within_10km_count_7d >= 3 then 'medium' end as severity
        from x_moment""",
    "x_normalized": f"""
        select arrival, cast(latitude as double) as lat, cast(longitude as double) as lon,
               case when acq_date <> '' and acq_time <> '' and acq_time <> '2561'
                    then cast(concat(acq_date, ' ', substring(lpad(acq_time, 4, '0'), 1, 2), ':', substring(lpad(acq_time, 4, '0'), 3, 2)) as timestamp)
                    when acq_date <> '' then cast(acq_date as timestamp) else cast(datetime as timestamp) end as time_utc,
               try_cast(nullif(frp, '') as double) as frp, nullif(confidence, '') as confidence,
               coalesce(nullif(satellite, ''), instrument) as satellite
        from v_fire_text where latitude <> 'bad'""",
    "x_inside": f"""
        select * from x_normalized where lat between {BBOX[2]} and {BBOX[0]} and lon between {BBOX[1]} and {BBOX[3]}
          and cast(time_utc as date) between date '2024-01-03' and date '2024-01-28'""",
    "x_inserted": """
        select * from (select *, row_number() over (partition by time_utc, round_even(lat, 4), round_even(lon, 4)
                                                    order by arrival desc) as rn from x_inside) t where rn = 1""",
    "x_wild_days": f"""
        select c.asset_id, f.date from x_asset_cell c join v_features f on f.lat = c.cell_lat and f.lng = c.cell_lng
        join x_resolved r on r.lat = f.lat and r.lng = f.lng and r.month = month(f.date)
        where f.date between date '{SCORING[0]}' and date '{SCORING[1]}'""",
    # detections carry whole minutes, so a week is exactly seven calendar days
    "x_wild_by_day": f"""
        select asset_id, day, min(km) as km, count(*) filter (where km <= 10) as n, max(frp) filter (where km <= 20) as frp
        from (select a.asset_id, cast(f.time_utc as date) - {SHIFT_DAYS} as day, f.frp, {_KM} as km
              from v_assets a cross join v_fires f) t
        group by asset_id, day""",
    "x_wild": """
        select d.asset_id, d.date, round_even(min(p.km), 3) as near7, coalesce(sum(p.n) filter (where p.day = d.date), 0) as c24,
               coalesce(sum(p.n), 0) as c7, round_even(max(p.frp), 3) as frp7
        from x_wild_days d left join x_wild_by_day p
          on p.asset_id = d.asset_id and p.day between d.date - 6 and d.date
        group by d.asset_id, d.date""",
    "x_wild_scores": """
        select *, case when near7 is null then 0 else cast(least(100, greatest(0, round_even(
                    greatest(0E0, (50 - least(near7, 50E0)) / 50E0) * 55E0 + least(c24 * 25E0 + c7 * 6E0, 35E0)
                    + least(coalesce(frp7, 0E0) / 200E0 * 10E0, 10E0), 0))) as int) end as score
        from x_wild""",
})

QUERIES = {
    "fire_csv_normalize": lambda t: plain(normalized(t)),
    "scan_fires_range": lambda t: plain(fl.scan_fires_range(t.v_fires, "2024-01-05 06:00:00", "2024-01-12 18:00:00")),
    "filter_bbox": lambda t: plain(fl.filter_bbox(t.v_fires, *BBOX, lat="lat", lng="lon")),
    "normalize_severity": lambda t: plain(fl.normalize_severity(t.v_notifications).select("id", "severity")),
    "severity_filter": lambda t: plain(fl.severity_filter(fl.normalize_severity(t.v_notifications), "high").select("id", "severity")),
    "asset_fire_features": lambda t: plain(features_by_moment(t)),
    "daily_fire_features": lambda t: plain(day_features(t)),
    "fires_anti": lambda t: plain(fi.fires_anti(t.v_fire_copies, _stored_fires(t)).select("event_id", "arrival")),
    "fire_batch_dedupe": lambda t: plain(fi.fire_batch_dedupe(t.v_fire_copies, "arrival").select("event_id", "time_utc", "lat_round", "lon_round", "frp")),
    "insert_new_fires": lambda t: plain(fi.insert_new_fires(t.v_fire_copies, _stored_fires(t), "arrival", "job-9").select(
        "event_id", "source", "time_utc", "lat_round", "lon_round", "frp", "raw_job_id")),
    "fire_ingest_run": _ingest,
    "fire_windows": lambda t: plain(month_windows(t).where("date >= date '2024-01-07'")),
    "score_wildfire": lambda t: plain(pe.entry_rows(day_features(t), ["asset_id", "date"], {"wildfire": pe.wildfire_entry()}).select(
        "asset_id", "date", "score", "band", F.concat_ws("; ", "drivers").alias("drivers"))),
    "batch_scores_wildfire": _batch_with_fires,
    "notifications_anti": lambda t: nt.notifications_anti(_candidates(t), t.v_notifications, NOW),
    "wildfire_notifications": lambda t: plain(nt.wildfire_notifications(t.v_assets, t.v_fires, t.v_notifications, NOW).select(
        "portfolio_id", "asset_id", "type", "severity", "dedup_key", "created_at", "payload.*")),
    "asset_wildfire_view": lambda t: fi.asset_wildfire_view(moment_features(t), "7d"),
    "asset_wildfire_view_24h": lambda t: fi.asset_wildfire_view(moment_features(t), "24h"),
    "ack_notification": _acks,
    "notification_order": lambda t: plain(nt.notification_order(t.v_notifications, "pf2").select("id", "portfolio_id", "created_at")),
    "notification_payload": lambda t: nt.parse_payload(t.v_notifications).select(
        "id", F.try_variant_get("payload", "$.k", "bigint").alias("k")),
    "severity_counts": lambda t: nt.severity_counts(fl.normalize_severity(t.v_notifications)),
    "unread_count": lambda t: nt.unread_count(t.v_notifications),
    "fire_metrics": lambda t: lg.fire_metrics(
        t.v_fires.withColumn("created_at", F.col("time_utc")), t.v_notifications,
        t.v_jobs.withColumn("created_at", F.to_timestamp(F.lit("2024-01-20 00:00:00"))), NOW, 24),
}

_SIX = ", ".join(FEATURES)
_DATE = "cast(date as varchar) as date"
_TEXTS = ("concat({c24}, ' active fires within 10km in last 24h; ', case when {near7} is null then 'no nearby fires detected in last 7d' "
          "else concat('nearest fire ', printf('%.1f', round_even({near7}, 1)), 'km away in last 7d') end)")
_NEAR7, _C24, _C7, _FRP7 = FEATURES[1], FEATURES[2], FEATURES[3], FEATURES[5]
_WILD = (f"cast(least(100, greatest(0, round_even(greatest(0E0, (50 - least({_NEAR7}, 50E0)) / 50E0) * 55E0 "
         f"+ least({_C24} * 25E0 + {_C7} * 6E0, 35E0) + least(coalesce({_FRP7}, 0E0) / 200E0 * 10E0, 10E0), 0))) as int)")

ORACLES = {
    "fire_csv_normalize": """
        select arrival, cast(time_utc as varchar) as time_utc, lat, lon, frp, confidence, satellite,
               round_even(lat, 4) as lat_round, round_even(lon, 4) as lon_round, concat('POINT(', lon, ' ', lat, ')') as geom_wkt
        from x_inside""",
    "scan_fires_range": """
        select event_id, cast(time_utc as varchar) as time_utc, lat, lon, frp, source from v_fires
        where time_utc between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-12 18:00:00'""",
    "filter_bbox": f"""
        select event_id, cast(time_utc as varchar) as time_utc, lat, lon, frp, source from v_fires
        where lat between {BBOX[2]} and {BBOX[0]} and lon between {BBOX[1]} and {BBOX[3]}""",
    "normalize_severity": "select id, case when lower(severity) in ('low', 'medium', 'high') then lower(severity) else 'low' end as severity from v_notifications",
    "severity_filter": "select id, 'high' as severity from v_notifications where lower(severity) = 'high'",
    "asset_fire_features": f"select asset_id, {_DATE}, {_SIX} from x_fire_days",
    "daily_fire_features": f"select asset_id, {_DATE}, {_SIX} from x_fire_days",
    "fires_anti": """
        select event_id, arrival from v_fire_copies f where not exists (
          select 1 from v_fire_copies s where s.frp > 50 and s.source = f.source and s.time_utc = f.time_utc
             and s.lat_round = f.lat_round and s.lon_round = f.lon_round)""",
    "fire_batch_dedupe": """
        select event_id, cast(time_utc as varchar) as time_utc, lat_round, lon_round, frp from (
          select *, row_number() over (partition by time_utc, lat_round, lon_round order by arrival desc) as rn from v_fire_copies) t
        where rn = 1""",
    "insert_new_fires": """
        select event_id, source, cast(time_utc as varchar) as time_utc, lat_round, lon_round, frp, 'job-9' as raw_job_id from (
          select *, row_number() over (partition by source, time_utc, lat_round, lon_round order by arrival desc) as rn from v_fire_copies) f
        where rn = 1 and not exists (
          select 1 from v_fire_copies s where s.frp > 50 and s.source = f.source and s.time_utc = f.time_utc
             and s.lat_round = f.lat_round and s.lon_round = f.lon_round)""",
    "fire_ingest_run": """
        select cast(time_utc as varchar) as time_utc, lat, lon, round_even(lat, 4) as lat_round, round_even(lon, 4) as lon_round,
               concat('POINT(', lon, ' ', lat, ')') as geom_wkt, frp, confidence, satellite, 'VIIRS_SNPP_NRT' as source, 'job-1' as raw_job_id
        from x_inserted""",
    "fire_windows": f"select asset_id, {_DATE}, {_SIX} from x_month where x_month.date >= date '2024-01-07'",
    "score_wildfire": f"""
        select asset_id, {_DATE}, {_WILD} as score, {_band_sql(_WILD)} as band, {_TEXTS.format(c24=_C24, near7=_NEAR7)} as drivers
        from x_fire_days""",
    "batch_scores_wildfire": f"""
        select asset_id, {_DATE}, 'wildfire' as peril, score, {_band_sql('score')} as band,
               {_TEXTS.format(c24='c24', near7='near7')} as drivers from x_wild_scores
        union all select asset_id, {_DATE}, peril, score, band, drivers from x_asset_scores""",
    "notifications_anti": f"""
        select id, portfolio_id, asset_id, concat('key-', substring(asset_id, 2, 9), '-2024-01-20') as dedup_key from v_notifications n
        where concat('key-', substring(asset_id, 2, 9), '-2024-01-20') not in (
          select dedup_key from v_notifications where created_at >= timestamp '{NOW}' - interval 1 day)""",
    "wildfire_notifications": f"""
        select portfolio_id, asset_id, 'wildfire_proximity' as type, severity,
               concat_ws(':', portfolio_id, asset_id, 'wildfire_proximity', severity, '2024-01-20') as dedup_key,
               '{NOW}' as created_at, {_SIX} from x_severity where severity is not null""",
    "asset_wildfire_view": f"""
        select asset_id, {FEATURES[1]} as nearest_fire_distance_km, {FEATURES[3]} as fires_within_10km_count,
               {FEATURES[5]} as max_frp_within_20km from x_moment""",
    "asset_wildfire_view_24h": f"""
        select asset_id, {FEATURES[0]} as nearest_fire_distance_km, {FEATURES[2]} as fires_within_10km_count,
               {FEATURES[4]} as max_frp_within_20km from x_moment""",
    "ack_notification": f"""
        select id, cast(case when severity = 'HIGH' then coalesce(acknowledged_at, timestamp '{NOW}') else acknowledged_at end as varchar) as acknowledged_at
        from v_notifications""",
    "notification_order": "select id, portfolio_id, cast(created_at as varchar) as created_at from v_notifications where portfolio_id = 'pf2'",
    "notification_payload": "select id, cast(json_extract(payload, '$.k') as bigint) as k from v_notifications",
    "severity_counts": """
        select count(*) filter (where lower(severity) = 'high') as high_count,
               count(*) filter (where lower(severity) = 'medium') as medium_count,
               count(*) filter (where severity is null or lower(severity) not in ('high', 'medium')) as low_count from v_notifications""",
    "unread_count": "select count(*) as unread from v_notifications where acknowledged_at is null",
    "fire_metrics": f"""
        select (select count(*) from v_fires where time_utc >= timestamp '{NOW}' - interval 24 hours) as fires_ingested,
               (select count(*) from v_notifications where created_at >= timestamp '{NOW}' - interval 24 hours) as alerts_generated,
               (select count(*) from v_jobs) as firms_jobs""",
}
