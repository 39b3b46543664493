"""Roll-ups of stored scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.functions.numbers import PERILS
from terrahaz.operators import filters as fl
from terrahaz.operators import ledgers as lg
from terrahaz.operators import portfolio as pf
from terrahaz.session import shared_folder
from terrahaz.sources import sinks

from .climate import _band_sql
from .common import QUARTER, WHOLE, plain, stored
from .views import STEPS, Tables

SEGMENT = "BUILDING"


def hazards(t: Tables) -> DataFrame:
    return pf.all_hazards_daily(t.v_scores)


def drivers(t: Tables) -> DataFrame:
    return t.v_score_bands.withColumn("drivers", F.array("driver"))


def _series_maps(t: Tables) -> DataFrame:
    """The map form, flattened again, must tell the same as the long form."""
    series = pf.batch_series(drivers(t), ["heat", "rain", "wind"])
    return plain(series.select("asset_id", "date", F.explode("scores").alias("peril", "score"), "bands", "drivers").select(
        "asset_id", "date", "peril", "score", F.try_element_at("bands", "peril").alias("band"),
        F.array_join(F.try_element_at("drivers", "peril"), ";").alias("drivers")))


def _latest(t: Tables) -> DataFrame:
    series = pf.batch_series(drivers(t), list(PERILS))
    return plain(pf.latest_series_point(series).select(
        "asset_id", "date", F.try_element_at("scores", F.lit("all")).alias("score_all")))


def _export(t: Tables) -> DataFrame:
    return pf.export_asset_max(drivers(t), t.v_assets)


def _export_csv(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "export")
    sinks.export_portfolio_csv(_export(t), path)
    return t.spark.read.option("header", "true").csv(path)


def _upsert_assets(t: Tables) -> DataFrame:
    moved = t.v_assets.where("lat > 39").select(
        "portfolio_id", "asset_id", F.col("lon").alias("lat"), F.col("lat").alias("lon"), F.lit(1).alias("arrival"))
    again = moved.withColumns({"lat": F.col("lat") + 1.0, "arrival": F.lit(2)})
    extra = t.v_assets.select(F.lit("NEW").alias("portfolio_id"), "asset_id", "lat", "lon", F.lit(1).alias("arrival"))
    table = stored(t.spark, "portfolio-assets", sinks.with_bucket(t.v_assets, "portfolio_id"), "bucket_no")
    sinks.store_portfolio_assets(table, moved.unionByName(again).unionByName(extra), "arrival")
    return table.read().drop("bucket_no")


TIE = ["asset_id", "date", "peril"]


def _late_page(t: Tables) -> DataFrame:
    """Page 900, served from the stored ranges of the sorted table."""
    path = shared_folder(t.spark, "score-ranges")
    lg.store_ranges(t.v_score_bands.select("score", *TIE), path, "score", False, TIE)
    return plain(lg.stored_page(t.spark, path, "score", False, 900, 25, TIE))


STEPS.update({
    "x_hazards": f"""
        select asset_id, date, score, {_band_sql('round_even(score, 0)')} as band
        from (select asset_id, date, avg(score) as score from v_scores group by asset_id, date) t""",
    "x_trend": """
        select date, peril, round_even(avg(score), 2) as avg_score from v_scores group by date, peril""",
    "x_series": """
        select asset_id, date, peril, cast(score as double) as score, lower(band) as band, driver from v_score_bands""",
    "x_chosen": f"""
        select * from v_scores where date between date '{QUARTER[0]}' and date '{QUARTER[1]}'
        and asset_id in (select asset_id from v_assets where portfolio_id = '{SEGMENT}')""",
    "x_chosen_hazards": """
        select asset_id, date, avg(score) as score from x_chosen group by asset_id, date""",
    "x_chosen_perils": """
        select peril, round_even(avg(score), 2) as v from x_chosen group by peril""",
    "x_chosen_trend": """
        select date, peril, round_even(avg(score), 2) as v from x_chosen group by date, peril""",
    "x_export": """
        select a.asset_id, a.lat, a.lon, b.* exclude (asset_id) from v_assets a join (
          select asset_id, coalesce(max(score) filter (where peril = 'heat'), 0) as score_heat,
                 coalesce(max(score) filter (where peril = 'rain'), 0) as score_precip,
                 coalesce(max(score) filter (where peril = 'wind'), 0) as score_wind,
                 coalesce(max(score) filter (where peril = 'drought'), 0) as score_drought,
                 coalesce(max(score) filter (where peril = 'wildfire'), 0) as score_wildfire,
                 string_agg(concat(peril, ':', driver), ' | ' order by case peril when 'heat' then 0 when 'rain' then 1
                                                                     when 'wind' then 2 when 'drought' then 3 else 4 end) as top_drivers
          from (select *, row_number() over (partition by asset_id, peril order by score desc, date) as rn
                from v_score_bands) r where rn = 1 group by asset_id) b using (asset_id)""",
})

_DATE = "cast(date as varchar) as date"
_LOW = "lower({})"

QUERIES = {
    "search_filter": lambda t: plain(fl.search_filter(t.v_score_bands, "A1", ["asset_id", "driver"], "Major")),
    "portfolio_scores": lambda t: plain(pf.portfolio_scores(t.v_scores, t.v_assets, SEGMENT, *WHOLE)),
    "band_distribution": lambda t: pf.band_distribution(t.v_score_bands),
    "all_hazards_daily": lambda t: plain(hazards(t), {"score": 9}),
    "band_counts": lambda t: pf.band_counts(hazards(t)),
    "band_percent": lambda t: pf.band_percent(pf.band_counts(hazards(t))),
    "peril_averages": lambda t: pf.peril_averages(t.v_scores),
    "trend_by_date": lambda t: plain(pf.trend_by_date(t.v_scores)),
    "trend_direction": lambda t: pf.trend_direction(hazards(t)),
    "top_assets": lambda t: pf.top_assets(t.v_scores, t.v_assets),
    "top_k_assets": lambda t: plain(pf.top_k_assets(hazards(t)), {"avg_score": 9}),
    "batch_series": lambda t: plain(pf.batch_series_long(t.v_score_bands, ["heat", "rain", "wind"])),
    "batch_series_maps": _series_maps,
    "latest_series_point": _latest,
    "export_asset_max": _export,
    "export_portfolio_csv": _export_csv,
    "list_portfolios": lambda t: pf.list_portfolios(t.v_assets),
    "risk_summary": lambda t: pf.risk_summary_long(t.v_scores, t.v_assets, SEGMENT, *QUARTER),
    "table_page": _late_page,
    "table_pages": lambda t: lg.page_count(t.v_score_bands, 25),
    "upsert_portfolio_assets": _upsert_assets,
}

ORACLES = {
    "search_filter": f"select asset_id, {_DATE}, peril, score, band, driver from v_score_bands where band = 'Major' and (contains(lower(asset_id), 'a1') or contains(lower(driver), 'a1'))",
    "portfolio_scores": f"""
        select asset_id, {_DATE}, peril, score from v_scores
        where asset_id in (select asset_id from v_assets where portfolio_id = '{SEGMENT}')""",
    "band_distribution": "select peril, band, count(*) as n from v_score_bands group by peril, band",
    "all_hazards_daily": f"select asset_id, {_DATE}, round_even(score, 9) as score, band from x_hazards",
    "band_counts": """
        select b.band, count(h.asset_id) as n from (values ('extreme'), ('major'), ('moderate'), ('minor'), ('minimal')) b(band)
        left join x_hazards h on lower(h.band) = b.band group by b.band""",
    "band_percent": """
        with c as (select b.band, count(h.asset_id) as n from (values ('extreme'), ('major'), ('moderate'), ('minor'), ('minimal')) b(band)
                   left join x_hazards h on lower(h.band) = b.band group by b.band)
        select band, n, floor(n / cast(sum(n) over () as double) * 1000 + 0.5) / 10 as pct from c""",
    "peril_averages": """
        with p as (select peril, round_even(avg(score), 2) as avg_score from v_scores group by peril)
        select * from p union all select 'all', round_even(avg(round_even(avg_score * 100, 0)), 0) / 100 from p""",
    "trend_by_date": f"""
        select {_DATE}, peril, avg_score from x_trend union all
        select {_DATE}, 'all', round_even(avg(round_even(avg_score * 100, 0)), 0) / 100 from x_trend group by x_trend.date""",
    "trend_direction": """
        with d as (select date, avg(score) as s from x_hazards group by date),
        e as (select arg_min(s, date) as a, arg_max(s, date) as z from d)
        select case when z - a > 2 then 'up' when z - a < -2 then 'down' else 'stable' end as direction,
               round_even(a, 2) as start_score, round_even(z, 2) as end_score from e""",
    "top_assets": f"""
        with best as (select asset_id, avg(score) as s from x_hazards group by asset_id order by s desc, asset_id limit 10)
        select b.asset_id, b.asset_id as name, a.lat, a.lon, lower({_band_sql('round_even(b.s, 0)')}) as band,
               {", ".join(f"coalesce(round_even(avg(v.score) filter (where v.peril = '{p}'), 2), 0E0) as score_{p}" for p in PERILS)},
               round_even(b.s, 2) as score_all
        from best b join v_scores v using (asset_id) left join v_assets a using (asset_id)
        group by b.asset_id, a.lat, a.lon, b.s""",
    "top_k_assets": """
        select asset_id, round_even(avg(score), 9) as avg_score from x_hazards group by asset_id
        order by avg(score) desc, asset_id limit 10""",
    "batch_series": f"""
        select asset_id, {_DATE}, peril, score, band from x_series union all
        select asset_id, {_DATE}, 'all', s, lower({_band_sql('s')})
        from (select asset_id, date, round_even(avg(score), 2) as s from x_series where peril in ('heat', 'rain', 'wind')
              group by asset_id, date) a""",
    "batch_series_maps": f"""
        select asset_id, {_DATE}, peril, score, band, driver as drivers from x_series union all
        select asset_id, {_DATE}, 'all', s, lower({_band_sql('s')}), null
        from (select asset_id, date, round_even(avg(score), 2) as s from x_series where peril in ('heat', 'rain', 'wind')
              group by asset_id, date) a""",
    "latest_series_point": """
        select asset_id, cast(max(date) as varchar) as date, arg_max(s, date) as score_all
        from (select asset_id, date, round_even(avg(score), 2) as s from v_scores group by asset_id, date) a group by asset_id""",
    "export_asset_max": "select * from x_export",
    "export_portfolio_csv": """
        select asset_id, cast(lat as varchar) as lat, cast(lon as varchar) as lon, cast(score_heat as varchar) as score_heat,
               cast(score_precip as varchar) as score_precip, cast(score_wind as varchar) as score_wind,
               cast(score_drought as varchar) as score_drought, cast(score_wildfire as varchar) as score_wildfire, top_drivers
        from x_export""",
    "list_portfolios": "select distinct portfolio_id, portfolio_id as name from v_assets",
    "risk_summary": f"""
        select 'bands' as part, b.band as key, cast(count(h.asset_id) as double) as value
        from (values ('extreme'), ('major'), ('moderate'), ('minor'), ('minimal')) b(band)
        left join x_chosen_hazards h on lower({_band_sql('round_even(h.score, 0)')}) = b.band group by b.band
        union all select 'peril_averages', peril, v from x_chosen_perils
        union all select 'peril_averages', 'all', round_even(avg(round_even(v * 100, 0)), 0) / 100 from x_chosen_perils
        union all select 'trend', concat(cast(date as varchar), '/', peril), v from x_chosen_trend
        union all select 'trend', concat(cast(date as varchar), '/all'), round_even(avg(round_even(v * 100, 0)), 0) / 100 from x_chosen_trend group by date
        union all (select 'top_assets', asset_id, round_even(avg(score), 2) from x_chosen_hazards group by asset_id
                   order by avg(score) desc, asset_id limit 10)""",
    "table_page": """
        select score, asset_id, cast(date as varchar) as date, peril from v_score_bands
        order by score desc, asset_id, v_score_bands.date, peril limit 25 offset 22475""",
    "table_pages": "select cast(ceil(count(*) / 25E0) as bigint) as pages from v_score_bands",
    "upsert_portfolio_assets": """
        select portfolio_id, asset_id, case when lat > 39 then lon + 1.0 else lat end as lat,
               case when lat > 39 then lat else lon end as lon from v_assets
        union all select 'NEW', asset_id, lat, lon from v_assets""",
}
