"""Features, thresholds, perils, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.functions.numbers import DEFAULT_PERILS, PERILS, band, normalize_perils
from terrahaz.operators import features as ft
from terrahaz.operators import filters as fl
from terrahaz.operators import perils as pe
from terrahaz.operators import quality, thresholds as th, units
from terrahaz.operators.nearest import nearest_cell
from terrahaz.plans.scoring import batch_scores, cell_rows
from terrahaz.session import shared_folder
from terrahaz.sources import readers, sinks
from terrahaz.sources.versions import spread

from .common import BASELINE, QUARTER, SCORING, VERSION, WHOLE, plain
from .views import STEPS, Tables

NEWEST = ["file_id", "k1", "k2"]
LIMITS = list(th.THRESHOLDS)


def _rounded(df: DataFrame) -> DataFrame:
    """Thresholds are kept with nine decimals."""
    return df.withColumns({c: F.bround(c, 9) for c in LIMITS})


def monthly(t: Tables) -> DataFrame:
    # thresholds are a stored table in practice; here they are kept for the session
    return _rounded(th.build_climatology(t.v_features, *BASELINE, VERSION, "month")).persist()


def by_doy(t: Tables) -> DataFrame:
    return _rounded(th.build_climatology(t.v_features, *BASELINE, VERSION, "doy")).persist()


def scored_cells(t: Tables) -> DataFrame:
    return cell_rows(t.v_features, monthly(t), None, *SCORING, VERSION)


def asset_scores(t: Tables, perils=DEFAULT_PERILS) -> DataFrame:
    return batch_scores(t.v_features, t.v_assets, monthly(t), None, *SCORING, VERSION, list(perils), separator="; ")


def entry_frame(t: Tables) -> DataFrame:
    """The flagship: every cell-day of the scoring range, scored for four perils."""
    return plain(pe.weather_scores(scored_cells(t), list(DEFAULT_PERILS)).select(
        "lat", "lng", "date", "peril", "score", "band", F.concat_ws("; ", "drivers").alias("drivers")))


# ---------------------------------------------------------------- SQL steps

_QUANTILES = ", ".join(
    f"round_even(quantile_cont({'p7' if '7d' in n else 'p30' if '30d' in n else c}, {q}), 9) as {n}"
    for n, (c, q) in th.THRESHOLDS.items())
_LIMITS = ", ".join(LIMITS)

STEPS.update({
    "x_rolled": f"""
        select *, sum(precip_sum) over (partition by lat, lng order by date rows between 6 preceding and current row) as p7,
               sum(precip_sum) over (partition by lat, lng order by date rows between 29 preceding and current row) as p30
        from v_features where date between date '{BASELINE[0]}' and date '{BASELINE[1]}'""",
    "x_monthly": f"""
        select lat as cell_lat, lng as cell_lng, cast(month(date) as int) as month, {_QUANTILES}
        from x_rolled group by lat, lng, month(date)""",
    "x_by_doy": f"""
        select lat as cell_lat, lng as cell_lng, cast(dayofyear(date) as int) as doy, {_QUANTILES}
        from x_rolled group by lat, lng, dayofyear(date)""",
    "x_asked": f"""
        select distinct lat, lng, cast(month(date) as int) as month from v_features
        where date between date '{SCORING[0]}' and date '{SCORING[1]}'""",
    "x_near_month": """
        select a.lat, a.lng, a.month, m.cell_lat, m.cell_lng,
               row_number() over (partition by a.lat, a.lng, a.month
                                  order by abs(m.cell_lat - a.lat) + abs(m.cell_lng - a.lng), m.cell_lat, m.cell_lng) as rn
        from x_asked a join x_monthly m on m.month = a.month""",
    "x_resolved": f"""
        select n.lat, n.lng, n.month, {_LIMITS}
        from x_near_month n join x_monthly m using (cell_lat, cell_lng, month) where n.rn = 1""",
    "x_days": f"""
        select *, count(*) over m as rows30, list(temp_max) over m as temps, list(wind_max) over m as winds,
               max(temp_max) over m as temp_peak, max(wind_max) over m as wind_peak,
               coalesce(sum(precip_sum) over w, 0) as sum7, max(precip_sum) over w as max7,
               coalesce(sum(precip_sum) over m, 0) as sum30, avg(soil_moisture_mean) over m as soil30
        from v_features where date between date '{SCORING[0]}' and date '{SCORING[1]}'
        window m as (partition by lat, lng order by date rows between 29 preceding and current row),
               w as (partition by lat, lng order by date rows between 6 preceding and current row)""",
    "x_rows": """
        select *, len(list_filter(temps, lambda x: x > coalesce(nullif(temp_max_p95, 0), 9999))) as hot_days,
               greatest(0E0, temp_peak - coalesce(nullif(temp_max_p95, 0), 9999)) as max_excess,
               len(list_filter(winds, lambda x: x > coalesce(nullif(wind_max_p95, 0), 9999))) as windy_days,
               wind_peak as max_wind, coalesce(nullif(precip_7d_p95, 0), 1E0) as q7_95,
               coalesce(nullif(precip_7d_p99, 0), nullif(precip_7d_p95, 0), 1E0) as q7_99,
               coalesce(nullif(precip_1d_p99, 0), 1E0) as q1_99, coalesce(nullif(wind_max_p95, 0), 1E0) as qw,
               coalesce(nullif(precip_30d_p10, 0), 1E0) as q30, coalesce(nullif(soil_moisture_p10, 0), 0.1E0) as qs
        from x_days d join x_resolved r on r.lat = d.lat and r.lng = d.lng and r.month = month(d.date)""",
    "x_cell_scores": """
        select lat, lng, date, 'heat' as peril,
               cast(least(100, greatest(0, round_even(hot_days / 30E0 * 80E0 + greatest(0, max_excess) * 4E0, 0))) as int) as score,
               concat(hot_days, ' hot days in last 30d above local p95; max exceedance ',
                      printf('%.2f', round_even(max_excess, 2)), 'C') as drivers
        from x_rows union all
        select lat, lng, date, 'rain',
               cast(least(100, greatest(0, round_even(sum7 / greatest(q7_95, 1E-6) * 45E0 + sum7 / greatest(q7_99, 1E-6) * 25E0
                                                      + max7 / greatest(q1_99, 1E-6) * 30E0, 0))) as int),
               concat('7d precip ', printf('%.1f', round_even(sum7, 1)), 'mm vs local p95 ', printf('%.1f', round_even(q7_95, 1)),
                      '; max 1d precip ', printf('%.1f', round_even(max7, 1)), 'mm vs local p99 ', printf('%.1f', round_even(q1_99, 1)))
        from x_rows union all
        select lat, lng, date, 'wind',
               cast(least(100, greatest(0, round_even(windy_days / 30E0 * 70E0 + max_wind / greatest(qw, 1E-6) * 30E0, 0))) as int),
               concat(windy_days, ' windy days in last 30d above local p95; max wind ', printf('%.1f', round_even(max_wind, 1)), ' m/s')
        from x_rows union all
        select lat, lng, date, 'drought',
               cast(least(100, greatest(0, round_even(greatest(0E0, 1 - sum30 / greatest(q30, 1E-6)) * 55E0
                                                      + greatest(0E0, 1 - soil30 / greatest(qs, 1E-6)) * 45E0, 0))) as int),
               concat('30d precip ', printf('%.1f', round_even(sum30, 1)), 'mm vs dry-tail p10 ', printf('%.1f', round_even(q30, 1)),
                      '; soil moisture ratio to p10: ', printf('%.3f', round_even(soil30, 3)), '/', printf('%.3f', round_even(qs, 3)))
        from x_rows""",
})


def _band_sql(score: str) -> str:
    return (f"case when {score} >= 80 then 'Extreme' when {score} >= 60 then 'Major' when {score} >= 40 then 'Moderate' "
            f"when {score} >= 20 then 'Minor' else 'Minimal' end")


STEPS["x_asset_cell"] = f"""
    select asset_id, cell_lat, cell_lng from (
      select a.asset_id, c.lat as cell_lat, c.lng as cell_lng,
             row_number() over (partition by a.asset_id order by abs(c.lat - a.lat) + abs(c.lng - a.lon), c.lat, c.lng) as rn
      from v_assets a cross join (select distinct lat, lng from v_features
                                  where date between date '{SCORING[0]}' and date '{SCORING[1]}') c) t
    where rn = 1"""
STEPS["x_asset_scores"] = f"""
    select a.asset_id, s.date, s.peril, s.score, {_band_sql('s.score')} as band, s.drivers
    from x_asset_cell a join x_cell_scores s on s.lat = a.cell_lat and s.lng = a.cell_lng"""
STEPS["x_hourly_first"] = """
    select time, point_id, lat, lng, variable, arg_min(value, event_id) as value
    from v_hourly group by time, point_id, lat, lng, variable"""
STEPS["x_hourly_wide"] = """
    select time, point_id, lat, lng,
           max(value) filter (where variable = '2m_temperature') as t,
           max(value) filter (where variable = 'total_precipitation') as p,
           max(value) filter (where variable = '10m_u_component_of_wind') as u,
           max(value) filter (where variable = '10m_v_component_of_wind') as v,
           max(value) filter (where variable = 'volumetric_soil_water_layer_1') as s
    from x_hourly_first group by time, point_id, lat, lng"""
STEPS["x_hourly_units"] = """
    select time, point_id, lat, lng,
           case when (select quantile_cont(t, 0.5) from x_hourly_wide) > 150 then t - 273.15E0 else t end as t,
           case when (select quantile_cont(p, 0.99) from x_hourly_wide) <= 5 then p * 1000E0 else p end as p,
           sqrt(u * u + v * v) as w, s
    from x_hourly_wide"""
STEPS["x_daily_points"] = """
    select cast(time as date) as date, point_id, lat, lng, avg(t) as temp_mean, max(t) as temp_max,
           coalesce(sum(p), 0) as precip_sum, max(w) as wind_max, avg(s) as soil_moisture_mean
    from x_hourly_units group by cast(time as date), point_id, lat, lng"""
STEPS["x_daily_grid_raw"] = """
    select cast(time as date) as date, lat, lng, avg(t) as tm, max(t) as tx, coalesce(sum(p), 0) as ps,
           max(sqrt(u * u + v * v)) as wind_max, avg(s) as soil_moisture_mean
    from x_hourly_wide group by cast(time as date), lat, lng"""

DAY4 = {"temp_mean": 9, "temp_max": 9, "precip_sum": 9, "wind_max": 9, "soil_moisture_mean": 9}


def wide_hourly(t: Tables) -> DataFrame:
    wide = ft.pivot_variables(t.v_hourly, tie="event_id")
    return wide.withColumn("batch", F.date_format("time", "yyyy"))


def daily_points(t: Tables) -> DataFrame:
    return ft.hourly_to_daily(wide_hourly(t), "batch")


def _short_hourly(df: DataFrame) -> DataFrame:
    names = {"2m_temperature": "t", "total_precipitation": "p", "10m_u_component_of_wind": "u",
             "10m_v_component_of_wind": "v", "volumetric_soil_water_layer_1": "s"}
    return df.withColumnsRenamed(names)


def _sink_round_trip(t: Tables, write, df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    path = shared_folder(t.spark, name)
    write(df, path)
    return plain(t.spark.read.parquet(path).select(*columns), DAY4)


def _write_climatology(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "climatology")
    sinks.sink_climatology(by_doy(t), path, "doy")
    sinks.sink_climatology(monthly(t), path, "month")
    both = sinks.read_climatology(t.spark, path, "month")
    return plain(both.select("climatology_version", "cell_lat", "cell_lng", "month", *LIMITS))


def _replace_scores(t: Tables) -> DataFrame:
    scores = t.v_scores.select("asset_id", "date", "peril", "score", F.lit(VERSION).alias("climatology_version"))
    fresh = scores.where("peril = 'heat'").withColumn("score", F.lit(100) - F.col("score"))
    fresh = fl.filter_date_range(fresh, *QUARTER)
    table = sinks.scores_table(scores, shared_folder(t.spark, "scores"))
    table.add(sinks.with_month(scores, "date"))
    sinks.write_scores(table, fresh, t.v_scores.select("asset_id"), *QUARTER, VERSION)
    return plain(table.read().drop("month_no"))


def _scan_files(t: Tables) -> DataFrame:
    """Features of the scoring range from stored files, found through their ledger."""
    path = shared_folder(t.spark, "feature-files")
    spread(t.v_features_raw.withColumn("year", F.year("date")), ["file_id", "year"], ["date"]).write.partitionBy("file_id", "year").parquet(path)
    ledger = readers.feature_ledger(t.spark, path)
    raw = readers.read_ledger_files(t.spark, path, ledger, *SCORING).drop("year")
    return plain(ft.scan_daily_features(raw, *SCORING, "file_id", NEWEST))


def _climate_series(t: Tables) -> DataFrame:
    cell = "lat = 37.0 and lng = 26.5"
    known = t.v_features.where(cell).withColumn("source", F.lit("era5"))
    forecast = t.v_features_raw.groupBy("date").agg(
        *[F.max(c).alias(c) for c in ft.FEATURE_VALUES]).withColumn("source", F.lit("open-meteo"))
    return plain(ft.climate_series(t.spark, known, forecast, *WHOLE, "2001-01-01"))


def _parts(t: Tables) -> DataFrame:
    return t.sql("""select event_id, case when event_id % 3 = 0 then null else value end as large_scale_precipitation,
                           value * 0.5E0 as convective_precipitation from v_hourly""")


QUERIES = {
    "scan_daily_features": lambda t: plain(ft.scan_daily_features(t.v_features_raw, *WHOLE, "file_id", NEWEST)),
    "scan_daily_features_files": _scan_files,
    "point_timeseries": lambda t: plain(ft.point_timeseries(
        t.spark, 37.9004, 26.6004, t.v_features_raw, *WHOLE, "file_id", NEWEST)),
    "batch_point_timeseries": lambda t: plain(ft.batch_point_timeseries(
        t.v_assets.select("asset_id", "lat", F.col("lon").alias("lng")), t.v_features_raw, *WHOLE, "file_id", NEWEST)),
    "hourly_point_sample": lambda t: plain(ft.hourly_point_sample(
        t.v_grid, t.v_assets.select(F.col("asset_id").alias("point_id"), "lat", "lon"), plain)),
    "filter_grid_bbox": lambda t: plain(fl.filter_grid_bbox(t.v_grid, 36.0, 40.0, 39.0, 30.0).select("event_id", "lat", "lng", "value")),
    "filter_date_range": lambda t: plain(fl.filter_date_range(t.v_features, *SCORING)),
    "filter_interval_overlap": lambda t: plain(fl.filter_interval_overlap(t.v_artifacts, *QUARTER)),
    "rename_aliases": lambda t: plain(ft.rename_aliases(t.v_hourly_short)),
    "canonical_features": lambda t: plain(ft.canonical_features(t.v_features_units, "file_id")),
    "unit_temp_to_celsius": lambda t: plain(units.unit_temp_to_celsius(t.v_features_units, "temp_max", "file_id").select(
        "date", "lat", "lng", "file_id", "k1", "k2", "temp_max")),
    "unit_precip_to_mm": lambda t: plain(units.unit_precip_to_mm(t.v_features_units, "precip_sum", "file_id").select(
        "date", "lat", "lng", "file_id", "k1", "k2", "precip_sum")),
    "precip_from_components": lambda t: ft.precip_from_components(_parts(t)),
    "tag_lineage": lambda t: plain(fl.tag_lineage(t.v_features, "aws_nsf_ncar_era5", "run-1", "2024-02-01 06:00:00")),
    "nearest_cell": lambda t: nearest_cell(
        t.v_assets.select(F.col("asset_id").alias("point_id"), "lat", F.col("lon").alias("lng")),
        ft.distinct_cells(t.v_features)),
    "nearest_axis_sample": lambda t: ft.nearest_axis_sample(
        t.v_assets.select(F.col("asset_id").alias("point_id"), "lat", "lon"), t.v_grid),
    "threshold_lookup": lambda t: plain(th.threshold_lookup(
        fl.filter_date_range(t.v_features, *SCORING).select("date", "lat", "lng"), monthly(t), by_doy(t), VERSION)),
    "threshold_nearest": lambda t: th.threshold_nearest(
        t.v_assets.select("lat", F.col("lon").alias("lng"), F.explode(F.array(F.lit(1), F.lit(7))).alias("month")), monthly(t)),
    "climate_series": _climate_series,
    "pivot_variables": lambda t: plain(_short_hourly(ft.pivot_variables(t.v_hourly, tie="event_id"))),
    "hourly_to_daily": lambda t: plain(daily_points(t).drop("time"), {**DAY4, "temp_mean_c": 9, "temp_max_c": 9, "precip_sum_mm": 9, "wind_max_ms": 9}),
    "hourly_to_daily_grid": lambda t: plain(ft.hourly_to_daily_grid(wide_hourly(t), "batch").drop("time"), DAY4),
    "climatology_month": lambda t: monthly(t),
    "climatology_doy": lambda t: by_doy(t),
    "feature_dq": lambda t: plain(quality.feature_dq(t.v_features).withColumn("warnings", F.concat_ws("; ", "warnings")),
                                  {f"{c}_null_ratio": 9 for c in quality.CHECKED}),
    "feature_dq_units": lambda t: plain(quality.feature_dq(ft.canonical_features(t.v_features_units, "file_id")).withColumn(
        "warnings", F.size("warnings")), {f"{c}_null_ratio": 9 for c in quality.CHECKED}),
    "ingest_dq_month": lambda t: plain(_month_report(t), {"missing_ratio": 9, "temp_c_min": 9, "temp_c_max": 9, "precip_min": 9,
                                                          **{f"nan_ratio_{n}": 9 for n in "tpuvs"}}),
    "ingest_dq_status": lambda t: quality.ingest_dq_status(_month_report(t)),
    "points_dq_status": lambda t: quality.points_dq_status(daily_points(t)).withColumn("warnings", F.concat_ws(";", "warnings")),
    "rolling_precip_7": lambda t: plain(th.rolling_precip(t.v_features).select("date", "lat", "lng", "precip_7d_sum")),
    "rolling_precip_30": lambda t: plain(th.rolling_precip(t.v_features).select("date", "lat", "lng", "precip_30d_sum")),
    "heat_window": lambda t: plain(scored_cells(t).select("date", "lat", "lng", "hot_days", "max_excess")),
    "rain_window": lambda t: plain(scored_cells(t).select("date", "lat", "lng", "sum7", "max7")),
    "wind_window": lambda t: plain(scored_cells(t).select("date", "lat", "lng", "windy_days", "max_wind")),
    "drought_window": lambda t: plain(scored_cells(t).select("date", "lat", "lng", "sum30", "soil30"), {"soil30": 9}),
    "dedupe_newest": lambda t: plain(ft.dedupe_newest(t.v_features_raw, NEWEST).drop("k1", "k2")),
    "concat_feature_files": lambda t: plain(ft.concat_feature_files(
        t.v_features_raw.where("file_id <= 3"), t.v_features_raw.where("file_id > 3").drop("soil_moisture_mean")).select(
        "date", "lat", "lng", "file_id", "k1", "temp_max", "soil_moisture_mean")),
    "distinct_cells": lambda t: ft.distinct_cells(t.v_features),
    "points_union": lambda t: ft.points_union(t.v_assets, t.v_provinces, "assets+provinces"),
    "batch_scores": lambda t: plain(asset_scores(t).select(
        "asset_id", "date", "peril", "score", "band", "drivers",
        "scenario", "horizon", "likelihood", "data_version", "climatology_version")),
    "sink_features_month": lambda t: _sink_round_trip(
        t, sinks.sink_features_month, t.v_features, "features-month",
        ["date", "year", "month", "lat", "lng", *ft.FEATURE_VALUES]),
    "sink_features_day": lambda t: _sink_round_trip(
        t, sinks.sink_features_day, daily_points(t).drop("year", "month"), "features-day",
        ["date", "year", "month", "day", "point_id", *ft.FEATURE_VALUES]),
    "sink_climatology": _write_climatology,
    "sink_scores_replace": _replace_scores,
    "normalize_perils": lambda t: plain(fl.filter_perils(t.v_scores, normalize_perils(["wind", "hail"]))),
    "score_band": lambda t: plain(t.v_scores.withColumn("band", band(F.col("score")))),
}
for _peril in DEFAULT_PERILS:
    QUERIES[f"score_{_peril}"] = lambda t, p=_peril: plain(
        pe.weather_scores(scored_cells(t), [p]).select("lat", "lng", "date", "score", "band", F.concat_ws("; ", "drivers").alias("drivers")))


def _month_report(t: Tables) -> DataFrame:
    hourly = wide_hourly(t).withColumn("month", F.date_format("time", "yyyy-MM"))
    daily = daily_points(t).withColumn("month", F.date_format("date", "yyyy-MM"))
    report = quality.ingest_dq_month(hourly, daily)
    short = {"nan_ratio_2m_temperature": "nan_ratio_t", "nan_ratio_total_precipitation": "nan_ratio_p",
             "nan_ratio_10m_u_component_of_wind": "nan_ratio_u", "nan_ratio_10m_v_component_of_wind": "nan_ratio_v",
             "nan_ratio_volumetric_soil_water_layer_1": "nan_ratio_s"}
    return report.withColumnsRenamed(short)


_VALUES = "temp_mean, temp_max, precip_sum, wind_max, soil_moisture_mean"
_VALUES6 = ", ".join(f"round_even({c}, 9) as {c}" for c in ft.FEATURE_VALUES)
_DATE = "cast(date as varchar) as date"
_UNITS = """
    from (select *, try_cast(temp_max as double) as tx from v_features_units) f
    join (select file_id, quantile_cont(temp_mean, 0.5) as qm, quantile_cont(try_cast(temp_max as double), 0.5) as qx,
                 quantile_cont(precip_sum, 0.99) as qp from v_features_units group by file_id) q using (file_id)"""
_NEAR_FILE = """
    select a.asset_id, c.file_id, c.lat, c.lng,
           row_number() over (partition by a.asset_id, c.file_id
                              order by abs(c.lat - a.lat) + abs(c.lng - a.lng), c.lat, c.lng) as rn
    from ({points}) a cross join (select distinct file_id, lat, lng from v_features_raw) c"""
_SERIES = """
    select {asset}cast(date as varchar) as date, temp_mean, temp_max, precip_sum, wind_max, soil_moisture_mean, 'era5' as source
    from (select n.asset_id, f.*, row_number() over (partition by n.asset_id, f.date
                                                     order by f.file_id desc, f.k1 desc, f.k2 desc) as pick
          from ({near}) n join v_features_raw f on f.file_id = n.file_id and f.lat = n.lat and f.lng = n.lng
          where n.rn = 1 and f.date between date '{start}' and date '{end}') t
    where pick = 1"""

ORACLES = {
    "scan_daily_features": f"select {_DATE}, month(date) as month, lat, lng, {_VALUES} from v_features",
    "scan_daily_features_files": f"""
        select {_DATE}, month(date) as month, lat, lng, {_VALUES} from v_features
        where v_features.date between date '{SCORING[0]}' and date '{SCORING[1]}'""",
    "point_timeseries": _SERIES.format(asset="", near=_NEAR_FILE.format(
        points="select 'p' as asset_id, 37.9E0 as lat, 26.6E0 as lng"), start=WHOLE[0], end=WHOLE[1]),
    "batch_point_timeseries": _SERIES.format(asset="asset_id, ", near=_NEAR_FILE.format(
        points="select asset_id, lat, lon as lng from v_assets"), start=WHOLE[0], end=WHOLE[1]),
    "hourly_point_sample": """
        with la as (select distinct lat from v_grid), lo as (select distinct lng from v_grid),
        pick as (select asset_id, p.lat, p.lon,
                        arg_min(la.lat, (abs(la.lat - p.lat), -la.lat)) as glat from v_assets p cross join la group by all),
        pick2 as (select asset_id, arg_min(lo.lng, (abs(lo.lng - p.lon), -lo.lng)) as glng
                  from v_assets p cross join lo group by asset_id)
        select cast(init_time + lead_hours * interval 1 hour as varchar) as time, asset_id as point_id, p.lat, p.lon as lng,
               g.variable, g.value
        from pick p join pick2 using (asset_id) join v_grid g on g.lat = glat and g.lng = glng""",
    "filter_grid_bbox": "select event_id, lat, lng, value from v_grid where lat between 36 and 39 and lng between 30 and 40",
    "filter_date_range": f"select {_DATE}, lat, lng, {_VALUES} from v_features where date between date '{SCORING[0]}' and date '{SCORING[1]}'",
    "filter_interval_overlap": f"""
        select artifact_type, uri, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date, row_count
        from v_artifacts where start_date <= date '{QUARTER[1]}' and end_date >= date '{QUARTER[0]}'""",
    "rename_aliases": "select event_id, cast(time as varchar) as time, lat, lng, variable, value from v_hourly",
    "canonical_features": f"""
        select {_DATE}, file_id, k1, k2, lat, lng, case when qm > 150 then temp_mean - 273.15E0 else temp_mean end as temp_mean,
               case when qx > 150 then tx - 273.15E0 else tx end as temp_max,
               case when qp <= 5 then precip_sum * 1000E0 else precip_sum end as precip_sum, wind_max, soil_moisture_mean,
               month(date) as month {_UNITS}""",
    "unit_temp_to_celsius": f"""
        select {_DATE}, lat, lng, file_id, k1, k2, case when qx > 150 then tx - 273.15E0 else tx end as temp_max {_UNITS}""",
    "unit_precip_to_mm": f"""
        select {_DATE}, lat, lng, file_id, k1, k2,
               case when qp <= 5 then precip_sum * 1000E0 else precip_sum end as precip_sum {_UNITS}""",
    "precip_from_components": """
        select event_id, case when event_id % 3 = 0 then null else value end as large_scale_precipitation,
               value * 0.5E0 as convective_precipitation,
               case when event_id % 3 = 0 then null else value end + value * 0.5E0 as total_precipitation from v_hourly""",
    "tag_lineage": f"""
        select {_DATE}, lat, lng, {_VALUES}, 'aws_nsf_ncar_era5' as source, 'run-1' as run_id,
               '2024-02-01 06:00:00' as ingested_at from v_features""",
    "nearest_cell": """
        select asset_id as point_id, cell_lat, cell_lng from (
          select a.asset_id, c.lat as cell_lat, c.lng as cell_lng,
                 row_number() over (partition by a.asset_id order by abs(c.lat - a.lat) + abs(c.lng - a.lon), c.lat, c.lng) as rn
          from v_assets a cross join (select distinct lat, lng from v_features) c) t where rn = 1""",
    "nearest_axis_sample": """
        with la as (select distinct lat from v_grid), lo as (select distinct lng from v_grid)
        select a.asset_id as point_id, a.lat as point_lat, a.lon as point_lng,
               arg_min(la.lat, (abs(la.lat - a.lat), -la.lat)) as grid_lat,
               arg_min(lo.lng, (abs(lo.lng - a.lon), -lo.lng)) as grid_lng
        from v_assets a cross join la cross join lo group by a.asset_id, a.lat, a.lon""",
    "threshold_lookup": f"""
        select {_DATE}, f.lat, f.lng, {", ".join(f"coalesce(d.{c}, r.{c}) as {c}" if False else f"case when d.doy is not null then d.{c} else r.{c} end as {c}" for c in LIMITS)}
        from v_features f
        left join x_by_doy d on d.cell_lat = f.lat and d.cell_lng = f.lng and d.doy = dayofyear(f.date)
        left join x_resolved r on r.lat = f.lat and r.lng = f.lng and r.month = month(f.date)
        where f.date between date '{SCORING[0]}' and date '{SCORING[1]}' and (d.doy is not null or r.month is not null)""",
    "threshold_nearest": f"""
        select lat, lng, month, {_LIMITS} from (
          select a.lat, a.lng, m.month, {_LIMITS},
                 row_number() over (partition by a.lat, a.lng, m.month
                                    order by abs(m.cell_lat - a.lat) + abs(m.cell_lng - a.lng), m.cell_lat, m.cell_lng) as rn
          from (select distinct lat, lon as lng from v_assets) a join x_monthly m on m.month in (1, 7)) t where rn = 1""",
    "climate_series": f"""
        with days as (select cast(unnest(generate_series(date '{WHOLE[0]}', date '{WHOLE[1]}', interval 1 day)) as date) as date),
        r as (select date, {_VALUES}, 'era5' as source from v_features where lat = 37.0 and lng = 26.5),
        f as (select date, {", ".join(f"max({c}) as {c}" for c in ft.FEATURE_VALUES)}, 'open-meteo' as source
              from v_features_raw group by date)
        select cast(d.date as varchar) as date, r.* exclude (date) from days d join r on r.date = d.date where d.date < date '2001-01-01'
        union all
        select cast(d.date as varchar), f.* exclude (date) from days d join f on f.date = d.date where d.date >= date '2001-01-01'
        union all
        select cast(d.date as varchar), r.* exclude (date) from days d join r on r.date = d.date
        where d.date >= date '2001-01-01' and d.date not in (select date from f)""",
    "pivot_variables": "select cast(time as varchar) as time, point_id, lat, lng, t, p, u, v, s from x_hourly_wide",
    "hourly_to_daily": f"""
        select {_DATE}, year(date) as year, month(date) as month, point_id, lat, lng, {_VALUES6},
               round_even(temp_mean, 9) as temp_mean_c, round_even(temp_max, 9) as temp_max_c,
               round_even(precip_sum, 9) as precip_sum_mm, round_even(wind_max, 9) as wind_max_ms from x_daily_points""",
    "hourly_to_daily_grid": """
        select '2024' as batch, cast(date as varchar) as date, year(date) as year, month(date) as month, lat, lng,
               round_even(case when (select quantile_cont(tm, 0.5) from x_daily_grid_raw) > 150 then tm - 273.15E0 else tm end, 9) as temp_mean,
               round_even(case when (select quantile_cont(tm, 0.5) from x_daily_grid_raw) > 150 then tx - 273.15E0 else tx end, 9) as temp_max,
               round_even(case when (select quantile_cont(ps, 0.99) from x_daily_grid_raw) <= 5 then ps * 1000E0 else ps end, 9) as precip_sum,
               round_even(wind_max, 9) as wind_max, round_even(soil_moisture_mean, 9) as soil_moisture_mean
        from x_daily_grid_raw""",
    "climatology_month": f"select '{VERSION}' as climatology_version, cell_lat, cell_lng, month, {_LIMITS} from x_monthly",
    "climatology_doy": f"select '{VERSION}' as climatology_version, cell_lat, cell_lng, doy, {_LIMITS} from x_by_doy",
    "feature_dq": """
        select 'pass' as dq_status, cast(null as varchar) as error,
               round_even(avg(case when temp_max is null then 1E0 else 0E0 end), 9) as temp_max_null_ratio,
               round_even(avg(case when precip_sum is null then 1E0 else 0E0 end), 9) as precip_sum_null_ratio,
               round_even(avg(case when wind_max is null then 1E0 else 0E0 end), 9) as wind_max_null_ratio,
               round_even(avg(case when soil_moisture_mean is null then 1E0 else 0E0 end), 9) as soil_moisture_mean_null_ratio,
               '' as warnings from v_features having min(temp_max) >= -40 and max(temp_max) <= 60""",
    "feature_dq_units": f"""
        with c as (select case when qx > 150 then tx - 273.15E0 else tx end as temp_max,
                          case when qp <= 5 then precip_sum * 1000E0 else precip_sum end as precip_sum,
                          wind_max, soil_moisture_mean {_UNITS})
        select case when min(precip_sum) < 0 or min(wind_max) < 0 then 'fail_dq'
                    when max(temp_max) > 60 or min(temp_max) < -40 or max(soil_moisture_mean) > 1 then 'success_with_warnings'
                    else 'pass' end as dq_status, cast(null as varchar) as error,
               round_even(avg(case when temp_max is null then 1E0 else 0E0 end), 9) as temp_max_null_ratio,
               round_even(avg(case when precip_sum is null then 1E0 else 0E0 end), 9) as precip_sum_null_ratio,
               round_even(avg(case when wind_max is null then 1E0 else 0E0 end), 9) as wind_max_null_ratio,
               round_even(avg(case when soil_moisture_mean is null then 1E0 else 0E0 end), 9) as soil_moisture_mean_null_ratio,
               cast(max(temp_max) > 60 as int) + cast(min(temp_max) < -40 as int) + cast(max(soil_moisture_mean) > 1 as int) as warnings
        from c""",
    "ingest_dq_month": """
        select m.month, expected_hours, actual_hours,
               round_even(greatest(0E0, (expected_hours - actual_hours) / cast(expected_hours as double)), 9) as missing_ratio,
               nan_ratio_t, nan_ratio_p, nan_ratio_u, nan_ratio_v, nan_ratio_s,
               temp_c_min, temp_c_max, precip_min
        from (select strftime(time, '%Y-%m') as month, count(distinct time) as actual_hours,
                     round_even(avg(case when t is null then 1E0 else 0E0 end), 9) as nan_ratio_t,
                     round_even(avg(case when p is null then 1E0 else 0E0 end), 9) as nan_ratio_p,
                     round_even(avg(case when u is null then 1E0 else 0E0 end), 9) as nan_ratio_u,
                     round_even(avg(case when v is null then 1E0 else 0E0 end), 9) as nan_ratio_v,
                     round_even(avg(case when s is null then 1E0 else 0E0 end), 9) as nan_ratio_s
              from x_hourly_wide group by strftime(time, '%Y-%m')) m
        join (select strftime(date, '%Y-%m') as month,
                     cast(24 * (datediff('day', min(date), max(date)) + 1) as bigint) as expected_hours,
                     round_even(min(temp_mean), 9) as temp_c_min, round_even(max(temp_max), 9) as temp_c_max,
                     round_even(min(precip_sum), 9) as precip_min
              from x_daily_points group by strftime(date, '%Y-%m')) d using (month)""",
    "ingest_dq_status": """
        select case when miss > 0.2 or low < -80 or high > 60 or wet < 0 then 'fail' when miss > 0.05 then 'warn' else 'pass' end as dq_status
        from (select 1 - (select count(distinct time) from x_hourly_wide)
                     / (24E0 * (datediff('day', min(date), max(date)) + 1)) as miss,
                     min(temp_mean) as low, max(temp_max) as high, min(precip_sum) as wet from x_daily_points) t""",
    "points_dq_status": """
        select case when min(precip_sum) < 0 or min(wind_max) < 0 then 'fail' when count(soil_moisture_mean) = 0 then 'warn' else 'pass' end as dq_status,
               case when count(soil_moisture_mean) = 0 then 'soil_moisture_missing' else '' end as warnings from x_daily_points""",
    "rolling_precip_7": f"""
        select {_DATE}, lat, lng, sum(precip_sum) over (partition by lat, lng order by v_features.date rows 6 preceding) as precip_7d_sum
        from v_features""",
    "rolling_precip_30": f"""
        select {_DATE}, lat, lng, sum(precip_sum) over (partition by lat, lng order by v_features.date rows 29 preceding) as precip_30d_sum
        from v_features""",
    "heat_window": f"select {_DATE}, lat, lng, cast(hot_days as int) as hot_days, max_excess from x_rows",
    "rain_window": f"select {_DATE}, lat, lng, sum7, max7 from x_rows",
    "wind_window": f"select {_DATE}, lat, lng, cast(windy_days as int) as windy_days, max_wind from x_rows",
    "drought_window": f"select {_DATE}, lat, lng, sum30, round_even(soil30, 9) as soil30 from x_rows",
    "dedupe_newest": f"""
        select {_DATE}, file_id, lat, lng, {_VALUES} from (
          select *, row_number() over (partition by lat, lng, date order by file_id desc, k1 desc, k2 desc) as rn
          from v_features_raw) t where rn = 1""",
    "concat_feature_files": f"""
        select {_DATE}, lat, lng, file_id, k1, temp_max, case when file_id <= 3 then soil_moisture_mean end as soil_moisture_mean
        from v_features_raw""",
    "distinct_cells": "select distinct lat, lng from v_features",
    "points_union": """
        select concat('asset:', asset_id) as point_id, lat, lon from v_assets union all
        select concat('province:', lpad(cast(plate as varchar), 2, '0')), lat, lng from v_provinces""",
    "batch_scores": f"""
        select asset_id, {_DATE}, peril, score, band, drivers, 'historical' as scenario, 'current' as horizon,
               'observed' as likelihood, 'era5_daily_v1' as data_version, '{VERSION}' as climatology_version from x_asset_scores""",
    "sink_features_month": f"select {_DATE}, year(date) as year, month(date) as month, lat, lng, {_VALUES} from v_features",
    "sink_features_day": f"""
        select {_DATE}, year(date) as year, month(date) as month, day(date) as day, point_id, {_VALUES6} from x_daily_points""",
    "sink_climatology": f"select '{VERSION}' as climatology_version, cell_lat, cell_lng, month, {_LIMITS} from x_monthly",
    "sink_scores_replace": f"""
        select asset_id, {_DATE}, peril, score, '{VERSION}' as climatology_version from v_scores
        where date not between date '{QUARTER[0]}' and date '{QUARTER[1]}' union all
        select asset_id, {_DATE}, peril, 100 - score, '{VERSION}' from v_scores
        where date between date '{QUARTER[0]}' and date '{QUARTER[1]}' and peril = 'heat'""",
    "normalize_perils": f"select asset_id, {_DATE}, peril, score from v_scores where peril = 'wind'",
    "score_band": f"select asset_id, {_DATE}, peril, score, {_band_sql('score')} as band from v_scores",
}
for _peril in DEFAULT_PERILS:
    ORACLES[f"score_{_peril}"] = (
        f"select lat, lng, {_DATE}, score, {_band_sql('score')} as band, drivers from x_cell_scores where peril = '{_peril}'")
ENTRY_ORACLE = f"select lat, lng, {_DATE}, peril, score, {_band_sql('score')} as band, drivers from x_cell_scores"
