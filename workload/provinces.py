"""Province model and dashboard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.operators import fires as fi
from terrahaz.operators import province as pv
from terrahaz.plans.province_run import run_provinces
from terrahaz.sources import readers, sinks

from .common import plain, stored
from .views import STEPS, Tables

AS_OF = "2000-06-15"
NOW = "2000-06-15 06:00:00"
RADIUS = 75


def dim(t: Tables) -> DataFrame:
    return pv.province_dim(t.v_provinces)


def rolled(t: Tables) -> DataFrame:
    return pv.province_rolling(t.v_rain)


def latest(t: Tables) -> DataFrame:
    return pv.latest_province_scores(dim(t), t.v_daily_scores)


def alerts(t: Tables) -> DataFrame:
    _, raised = run_provinces(dim(t), t.v_rain, t.v_fires, AS_OF, NOW, 30, RADIUS)
    return raised


def _map_names(t: Tables) -> DataFrame:
    risks = t.v_provinces.select(
        F.col("plate").alias("seq"), F.col("name"), F.initcap("name").alias("name_en"), (F.col("plate") * 3).alias("risk"))
    regions = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, "c").otherwise("x").alias("kind"), "c_nationkey").join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("kind") == "c", F.col("n_name")).otherwise(F.concat(F.lit("No "), F.lower("n_name"))).alias("region_name"))
    return pv.map_name_join(regions, risks)


def _upsert_scores(t: Tables) -> DataFrame:
    incoming = t.v_daily_scores.where("flood_score > 50").withColumns(
        {"overall_score": F.lit(0), "arrival": F.lit(1)})
    later = incoming.where("drought_score > 50").withColumns({"overall_score": F.lit(1), "arrival": F.lit(2)})
    table = stored(t.spark, "daily-scores", sinks.with_month(t.v_daily_scores, "as_of_date"), "month_no")
    sinks.store_daily_scores(table, incoming.unionByName(later), "arrival")
    return plain(table.read().drop("month_no"))


def _loss(t: Tables) -> DataFrame:
    asked = t.v_provinces.select(F.col("id").alias("province_id"), (F.col("plate") * 10).cast("bigint").alias("policy_count"),
                                 (F.col("population") * 8.0).alias("sum_insured"))
    return pv.insured_loss(asked, latest(t)).withColumn("recommendations", F.concat_ws(" ", "recommendations"))


def _replace_alerts(t: Tables) -> DataFrame:
    fresh = t.v_alerts.where("level = 'HIGH'").withColumns(
        {"id": F.concat(F.lit("new-"), F.col("id")), "active": F.lit(True)})
    table = stored(t.spark, "alerts", t.v_alerts, "active")
    sinks.store_active_alerts(table, fresh)
    return plain(table.read())


_KM = ("2 * 6371E0 * asin(sqrt(pow(sin(radians(f.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(f.lat)) "
       "* pow(sin(radians(f.lon - p.lng) / 2), 2)))")

STEPS.update({
    "x_roll_sums": """
        select *, row_number() over w as n,
               sum(rain) over (partition by province_id order by date rows between 6 preceding and current row) as r7,
               sum(rain) over (partition by province_id order by date rows between 59 preceding and current row) as r60,
               sum(rain) over (partition by province_id order by date rows between 13 preceding and 7 preceding) as prev7
        from v_rain window w as (partition by province_id order by date)""",
    "x_roll": """
        select *, case when n >= 7 then coalesce(avg(case when n >= 7 then r7 end) over (
                    partition by province_id order by date rows between unbounded preceding and 1 preceding), r7) else 1E0 end as base7,
               case when n >= 120 then avg(case when n >= 60 then r60 end) over (
                    partition by province_id order by date rows between unbounded preceding and 2 preceding)
                    else greatest(1E0, r60) end as base60
        from x_roll_sums""",
    "x_prov_scores": """
        select *, cast(round_even(0.65E0 * flood_score + 0.35E0 * drought_score, 0) as int) as overall_score,
               case when n < 14 then 'STABLE' when prev7 <= 0 then case when r7 > 0 then 'UP' else 'STABLE' end
                    when (r7 - prev7) / prev7 * 100E0 >= 8 then 'UP' when (r7 - prev7) / prev7 * 100E0 <= -8 then 'DOWN'
                    else 'STABLE' end as trend,
               case when n < 14 then 0E0 when prev7 <= 0 then case when r7 > 0 then 100E0 else 0E0 end
                    else round_even(abs((r7 - prev7) / prev7 * 100E0), 1) end as trend_pct
        from (select *, cast(round_even(least(100E0, greatest(0E0, (r7 / greatest(1E0, base7) - 0.5E0) * 80E0)), 0) as int) as flood_score,
                     cast(round_even(least(100E0, greatest(0E0, least(1E0, greatest(0E0, 1 - r60 / greatest(1E0, base60))) * 120E0)), 0) as int) as drought_score
              from x_roll) t""",
    "x_hits": f"""
        select p.id, count(*) as hits from v_provinces p cross join v_fires f where {_KM} <= {RADIUS} group by p.id""",
    "x_latest": """
        select * from (select s.*, row_number() over (partition by province_id order by as_of_date desc) as rn from v_daily_scores s) t
        join (select id as pid, name, region from v_provinces) p on p.pid = t.province_id where rn = 1""",
    "x_alerts": f"""
        select concat('flood-', province_id, '-{AS_OF}') as id, province_id, 'HIGH' as level, 'FLOOD' as risk_type,
               1200 + flood_score * 10 as affected_policies, 750000 + flood_score * 17500 as estimated_loss_usd,
               concat('Heavy rainfall anomaly for ', name, '. 7-day rainfall: ', printf('%.1f', round_even(r7, 1)), ' mm.') as message
        from x_prov_scores s join v_provinces p on p.id = s.province_id where s.date = date '{AS_OF}' and flood_score >= 85
        union all
        select concat('drought-', province_id, '-{AS_OF}'), province_id, case when drought_score >= 75 then 'HIGH' else 'MEDIUM' end,
               'DROUGHT', 900 + drought_score * 9, 500000 + drought_score * 12000,
               concat('60-day rainfall deficit elevated in ', name, '. Drought score: ', drought_score, '.')
        from x_prov_scores s join v_provinces p on p.id = s.province_id where s.date = date '{AS_OF}' and drought_score >= 60
        union all
        select concat('wildfire-', p.id, '-{AS_OF}'), p.id, case when hits >= 10 then 'HIGH' else 'MEDIUM' end, 'WILDFIRE',
               700 + hits * 35, 350000 + hits * 60000,
               concat('NASA FIRMS detected ', hits, ' recent hotspot(s) within {RADIUS} km of ', name, '.')
        from x_hits h join v_provinces p using (id)""",
})

_SCORE_COLUMNS = "flood_score, drought_score, overall_score, risk_level, trend"
_DATE = "cast(date as varchar) as date"
_ASOF = "cast(as_of_date as varchar) as as_of_date"
_LEVEL = "case when overall_score >= 75 then 'HIGH' when overall_score >= 50 then 'MEDIUM' else 'LOW' end"
_ADVICE = "concat_ws(' ', " + ", ".join([
    f"case when {s}_score >= 75 then '{' '.join(pv.ADVICE[s + '_high'])}' when {s}_score >= 50 then '{pv.ADVICE[s + '_medium'][0]}' end"
    for s in ("flood", "drought")] + [
    f"case risk_level when 'HIGH' then '{' '.join(pv.ADVICE['level_high'])}' when 'MEDIUM' then '{pv.ADVICE['level_medium'][0]}' end",
    f"case when trend = 'UP' then '{pv.ADVICE['rising'][0]}' end"]) + ")"
_ADVICE = f"coalesce(nullif({_ADVICE}, ''), '{pv.ADVICE['none'][0]}')"

QUERIES = {
    "province_dim": dim,
    "daily_json_to_rows": lambda t: plain(readers.daily_json_to_rows(t.v_daily_json, "json", ["province_id"])),
    "daily_rain_history": lambda t: readers.daily_json_rain(t.v_daily_json, "json", ["province_id", "month"]).select(
        "province_id", "month", F.concat_ws(",", F.transform("rain", lambda v: v.cast("bigint").cast("string"))).alias("rain")),
    "province_rolling_7d": lambda t: plain(rolled(t).select("province_id", "date", "r7", "base7"), {"base7": 9}),
    "province_rolling_60d": lambda t: plain(rolled(t).select("province_id", "date", "r60", "base60"), {"base60": 9}),
    "province_trend": lambda t: plain(pv.province_trend(rolled(t)).select("province_id", "date", "trend", "trend_pct")),
    "province_asof_scores": lambda t: plain(pv.province_asof_scores(pv.daily_rain_history(t.v_rain_readings), "2001-07-31", 365)),
    "province_flood_score": lambda t: plain(pv.score_provinces(t.v_rain).select("province_id", "as_of_date", "flood_score", "rain_7d_mm")),
    "province_drought_score": lambda t: plain(pv.score_provinces(t.v_rain).select("province_id", "as_of_date", "drought_score", "rain_60d_mm")),
    "province_overall": lambda t: plain(pv.score_provinces(t.v_rain).select("province_id", "as_of_date", "overall_score", "risk_level")),
    "province_hotspot_count": lambda t: fi.province_hotspot_count(t.v_provinces, t.v_fires, float(RADIUS)),
    "province_alerts": lambda t: plain(alerts(t).drop("issued_at", "active")),
    "replace_active_alerts": _replace_alerts,
    "latest_province_scores": lambda t: plain(pv.latest_province_scores(
        dim(t), t.v_daily_scores, "ASIA", 10, None, 100).select("province_id", "name", "region", "as_of_date", *_SCORE_COLUMNS.split(", "))),
    "latest_province_one": lambda t: plain(pv.latest_province_one(dim(t), t.v_daily_scores, "7").select(
        "province_id", "name", "as_of_date", *_SCORE_COLUMNS.split(", "))),
    "latest_as_of_date": lambda t: plain(pv.latest_as_of_date(t.v_daily_scores)),
    "top_k_provinces": lambda t: plain(pv.top_k_provinces(latest(t)).select("province_id", "overall_score")),
    "active_alerts": lambda t: plain(pv.active_alerts(t.v_alerts, dim(t), "HIGH")),
    "alert_order": lambda t: plain(pv.active_alerts(t.v_alerts, dim(t), None, 50).select("id", "level", "estimated_loss_usd")),
    "alerts_source_label": lambda t: pv.alerts_source_label(t.v_alerts),
    "dashboard_stats": lambda t: pv.dashboard_stats(latest(t), pv.active_alerts(t.v_alerts, dim(t))),
    "alert_level_counts": lambda t: pv.alert_level_counts(pv.active_alerts(t.v_alerts, dim(t))),
    "insured_loss": _loss,
    "recommendations": lambda t: plain(pv.recommendations(t.v_daily_scores).withColumn(
        "recommendations", F.concat_ws(" ", "recommendations")).select("province_id", "as_of_date", "recommendations")),
    "map_name_join": _map_names,
    "upsert_daily_scores": _upsert_scores,
}

ORACLES = {
    "province_dim": "select id, plate, name, region, lat, lng, population, population * 18000 as insured_assets from v_provinces",
    "daily_json_to_rows": """
        select province_id, cast(date as varchar) as date, cast(null as double) as temp_mean,
               case when day(date) <= 20 then cast(day(date) as double) end as temp_max, rain as precip_sum,
               cast(null as double) as wind_max, cast(null as double) as soil_moisture_mean, 'open-meteo' as source
        from v_rain_readings""",
    "daily_rain_history": """
        select province_id, strftime(date, '%Y-%m') as month, string_agg(cast(cast(rain as bigint) as varchar), ',' order by date) as rain
        from v_rain group by province_id, strftime(date, '%Y-%m')""",
    "province_rolling_7d": f"select province_id, {_DATE}, r7, round_even(base7, 9) as base7 from x_roll",
    "province_rolling_60d": f"select province_id, {_DATE}, r60, round_even(base60, 9) as base60 from x_roll",
    "province_trend": f"select province_id, {_DATE}, trend, trend_pct from x_prov_scores",
    "province_asof_scores": f"""
        select province_id, cast(date as varchar) as as_of_date, flood_score, drought_score, overall_score, {_LEVEL} as risk_level,
               trend, trend_pct, round_even(r7, 1) as rain_7d_mm, round_even(r60, 1) as rain_60d_mm
        from x_prov_scores where date > date '2001-07-31' - 365 and date <= date '2001-07-31'""",
    "province_flood_score": "select province_id, cast(date as varchar) as as_of_date, flood_score, round_even(r7, 1) as rain_7d_mm from x_prov_scores",
    "province_drought_score": "select province_id, cast(date as varchar) as as_of_date, drought_score, round_even(r60, 1) as rain_60d_mm from x_prov_scores",
    "province_overall": f"select province_id, cast(date as varchar) as as_of_date, overall_score, {_LEVEL} as risk_level from x_prov_scores",
    "province_hotspot_count": "select id, hits from x_hits",
    "province_alerts": "select * from x_alerts",
    "replace_active_alerts": """
        select id, province_id, level, risk_type, affected_policies, estimated_loss_usd, cast(issued_at as varchar) as issued_at, active
        from v_alerts where not active union all
        select concat('new-', id), province_id, level, risk_type, affected_policies, estimated_loss_usd, cast(issued_at as varchar), true
        from v_alerts where level = 'HIGH'""",
    "latest_province_scores": f"""
        select province_id, name, region, {_ASOF}, {_SCORE_COLUMNS} from x_latest where region = 'ASIA' and overall_score >= 10
        order by overall_score desc, province_id limit 100""",
    "latest_province_one": f"select province_id, name, {_ASOF}, {_SCORE_COLUMNS} from x_latest where province_id = '7'",
    "latest_as_of_date": "select cast(max(as_of_date) as varchar) as as_of_date from v_daily_scores",
    "top_k_provinces": "select province_id, overall_score from x_latest order by overall_score desc, province_id limit 5",
    "active_alerts": """
        select a.id, province_id, level, risk_type, affected_policies, estimated_loss_usd, cast(issued_at as varchar) as issued_at,
               active, p.name as province_name from v_alerts a join v_provinces p on p.id = a.province_id where active and level = 'HIGH'""",
    "alert_order": """
        select id, level, estimated_loss_usd from v_alerts where active
        order by case when level = 'HIGH' then 0 else 1 end, estimated_loss_usd desc, issued_at desc, id limit 50""",
    "alerts_source_label": """
        select case when bool_or(risk_type = 'WILDFIRE') then 'open-meteo+firms' when count(*) > 0 then 'open-meteo' end as data_source from v_alerts""",
    "dashboard_stats": """
        select (select count(*) from x_latest where risk_level = 'HIGH') as high, (select count(*) from x_latest where risk_level = 'MEDIUM') as medium,
               (select count(*) from x_latest where risk_level = 'LOW') as low, cast(sum(affected_policies) as bigint) as total_policies,
               cast(sum(estimated_loss_usd) as bigint) as total_loss_usd from v_alerts where active""",
    "alert_level_counts": """
        select count(*) filter (where level = 'HIGH') as high_count, count(*) filter (where level = 'MEDIUM') as medium_count from v_alerts where active""",
    "insured_loss": f"""
        select province_id, risk_level, cast(plate * 10 as bigint) as policy_count, si as sum_insured, flood_score, drought_score,
               round_even(fl, 2) as flood_loss, round_even(fl / si, 4) as flood_loss_ratio, round_even(dl, 2) as drought_loss,
               round_even(dl / si, 4) as drought_loss_ratio, round_even(fl + dl, 2) as total_loss,
               round_even((fl + dl) / si, 4) as combined_loss_ratio, round_even((fl + dl) * 1.40E0, 2) as suggested_premium,
               {_ADVICE} as recommendations
        from (select l.*, p.plate, p.population * 8E0 as si, p.population * 8E0 * flood_score * 0.0015E0 as fl,
                     p.population * 8E0 * drought_score * 0.0008E0 as dl
              from x_latest l join v_provinces p on p.id = l.province_id) t""",
    "recommendations": f"select province_id, {_ASOF}, {_ADVICE} as recommendations from v_daily_scores",
    "map_name_join": """
        select case when c_custkey % 2 = 0 then n_name else concat('No ', lower(n_name)) end as region_name,
               case when c_custkey % 2 = 0 then (n_nationkey + 1) * 3 else 0 end as risk_score,
               case when c_custkey % 2 = 0 then array_to_string(list_transform(string_split(lower(n_name), ' '),
                        lambda w: upper(w[1]) || w[2:]), ' ') else concat('No ', lower(n_name)) end as province_name
        from customer join nation on c_nationkey = n_nationkey""",
    "upsert_daily_scores": f"""
        select province_id, {_ASOF}, flood_score, drought_score,
               case when flood_score > 50 and drought_score > 50 then 1 when flood_score > 50 then 0 else overall_score end as overall_score,
               risk_level, trend from v_daily_scores""",
}
