"""Climate tables derived from the supplied tables.

The texts run unchanged in Spark and in DuckDB.  Every view reads its whole base
table; numbers are whole multiples of powers of two where sums must agree to the
last bit.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from terrahaz.session import use_utc

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

VIEWS = {
    # daily features with copies: file_id plays the newest file
    "v_features_raw": """
        select cast(l_shipdate as date) as date, l_linenumber as file_id, l_orderkey as k1, l_partkey as k2,
               36.0E0 + (l_suppkey % 25) * 0.25E0 as lat, 26.0E0 + floor(l_suppkey / 25E0) * 0.25E0 as lng,
               l_quantity - 5E0 as temp_mean, l_quantity as temp_max,
               round(l_discount * 100E0) * 10E0 as precip_sum, round(l_tax * 100E0) * 2.5E0 as wind_max,
               (l_partkey % 64) / 128E0 as soil_moisture_mean
        from lineitem""",
    # the same readings, some files in Kelvin and metres, some values unusable
    "v_features_units": """
        select date, file_id, k1, k2, lat, lng,
               case when file_id % 2 = 0 then temp_mean + 273E0 else temp_mean end as temp_mean,
               case when k2 % 50 = 0 then 'n/a'
                    when file_id % 3 = 0 then cast(temp_max + 273E0 as varchar(40))
                    else cast(temp_max as varchar(40)) end as temp_max,
               case when file_id % 2 = 1 then precip_sum / 1024E0 else precip_sum end as precip_sum,
               wind_max, soil_moisture_mean
        from v_features_raw""",
    "v_features": """
        select date, lat, lng, temp_mean, temp_max, precip_sum, wind_max, soil_moisture_mean
        from (select *, row_number() over (partition by lat, lng, date
                                           order by file_id desc, k1 desc, k2 desc) as rn
              from v_features_raw) t
        where rn = 1""",
    # feature files: one per line number and year
    "v_artifacts": """
        select 'feature_daily_parquet' as artifact_type, concat('file-', l_linenumber, '-', year(l_shipdate)) as uri,
               cast(min(l_shipdate) as date) as start_date, cast(max(l_shipdate) as date) as end_date,
               cast(count(*) as bigint) as row_count
        from lineitem group by l_linenumber, year(l_shipdate)""",
    # hourly readings in long form
    "v_hourly": """
        select event_id, date_trunc('hour', ts) as time, concat('p', user_id % 4) as point_id,
               36E0 + (user_id % 4) * 0.25E0 as lat, 26E0 + (user_id % 4) * 0.5E0 as lng,
               case event_type when 'view' then '2m_temperature' when 'click' then 'total_precipitation'
                    when 'purchase' then '10m_u_component_of_wind' when 'signup' then '10m_v_component_of_wind'
                    else 'volumetric_soil_water_layer_1' end as variable,
               case event_type when 'view' then 273E0 + cast(round(value * 100E0) as bigint) % 40
                    when 'click' then (cast(round(value * 100E0) as bigint) % 64) / 16384E0
                    when 'purchase' then cast(round(value * 100E0) as bigint) % 41 - 20E0
                    when 'signup' then cast(round(value * 100E0) as bigint) % 37 - 18E0
                    else (cast(round(value * 100E0) as bigint) % 64) / 128E0 end as value
        from events""",
    # the same under the short names files use
    "v_hourly_short": """
        select event_id, time as valid_time, lat as latitude, lng as longitude,
               case variable when '2m_temperature' then case when event_id % 2 = 0 then 't2m' else 'VAR_2T' end
                    when 'total_precipitation' then case when event_id % 2 = 0 then 'tp' else 'var_tp' end
                    when '10m_u_component_of_wind' then 'U10' when '10m_v_component_of_wind' then 'var_10v'
                    else 'SWVL1' end as variable, value
        from v_hourly""",
    # a grid: every reading at one of 32 x 64 nodes
    "v_grid": """
        select event_id, date_trunc('hour', ts) as init_time, cast(event_id % 6 as int) as lead_hours,
               36E0 + (event_id % 32) * 0.1875E0 as lat, 26E0 + ((event_id * 5) % 64) * 0.25E0 as lng,
               '2m_temperature' as variable, 273E0 + cast(round(value * 100E0) as bigint) % 40 as value
        from events""",
    # satellite detections
    "v_fires": """
        select event_id, date_trunc('minute', ts) as time_utc,
               36E0 + ((event_id * 7) % 600) / 100E0 as lat, 26E0 + ((event_id * 13) % 1900) / 100E0 as lon,
               value as frp, concat('S', event_id % 2) as source
        from events""",
    # the same as delivered text, with the defects such files have
    "v_fire_text": """
        select event_id as arrival,
               case when event_id % 97 = 0 then 'bad' else cast(lat as varchar(40)) end as latitude,
               cast(lon as varchar(40)) as longitude,
               case when event_id % 89 = 0 then '' else substring(cast(time_utc as varchar(40)), 1, 10) end as acq_date,
               case when event_id % 83 = 0 then '' when event_id % 79 = 0 then '2561'
                    else cast(cast(hour(time_utc) * 100 + minute(time_utc) as int) as varchar(10)) end as acq_time,
               substring(cast(time_utc as varchar(40)), 1, 19) as datetime,
               case when event_id % 11 = 0 then '' when event_id % 13 = 0 then 'x'
                    else cast(frp as varchar(40)) end as frp,
               case when event_id % 5 = 0 then '' else 'nominal' end as confidence,
               case when event_id % 7 = 0 then '' else 'N' end as satellite, 'VIIRS' as instrument
        from v_fires""",
    # each detection delivered up to three times
    "v_fire_copies": """
        select event_id, event_id * 3 + copy as arrival, time_utc, lat, lon, lat as lat_round, lon as lon_round,
               frp + copy as frp, source
        from (select *, 0 as copy from v_fires
              union all select *, 1 as copy from v_fires where event_id % 3 >= 1
              union all select *, 2 as copy from v_fires where event_id % 3 >= 2) c""",
    "v_assets": """
        select c_mktsegment as portfolio_id, concat('a', c_custkey) as asset_id,
               36E0 + ((c_custkey * 37) % 600) / 100E0 as lat, 26E0 + ((c_custkey * 53) % 1900) / 100E0 as lon
        from customer""",
    "v_provinces": """
        select cast(n_nationkey + 1 as varchar(10)) as id, n_nationkey + 1 as plate, n_name as name, r_name as region,
               36E0 + n_nationkey * 0.25E0 as lat, 26E0 + n_nationkey * 0.75E0 as lng,
               cast((n_nationkey + 1) * 100000 as bigint) as population
        from nation join region on n_regionkey = r_regionkey""",
    # daily rain per province, missing on days without orders
    "v_rain_readings": """
        select d.id as province_id, d.date, r.rain
        from (select id, plate, {all_days} as date from v_provinces) d
        left join (select c_nationkey + 1 as plate, cast(o_orderdate as date) as date,
                          cast(sum(o_orderkey % 16) as double) as rain
                   from orders join customer on o_custkey = c_custkey
                   group by c_nationkey + 1, cast(o_orderdate as date)) r
          on r.plate = d.plate and r.date = d.date""",
    "v_rain": """
        select province_id, date, coalesce(rain, 0E0) as rain from v_rain_readings""",
    "v_daily_scores": """
        select cast(c_nationkey + 1 as varchar(10)) as province_id, cast(o_orderdate as date) as as_of_date,
               cast(max(o_orderkey % 101) as int) as flood_score,
               cast(max((o_orderkey * 7) % 101) as int) as drought_score,
               cast(max((o_orderkey * 3) % 101) as int) as overall_score,
               case when max((o_orderkey * 3) % 101) >= 75 then 'HIGH'
                    when max((o_orderkey * 3) % 101) >= 50 then 'MEDIUM' else 'LOW' end as risk_level,
               case max(o_orderkey) % 3 when 0 then 'UP' when 1 then 'DOWN' else 'STABLE' end as trend
        from orders join customer on o_custkey = c_custkey
        group by c_nationkey, cast(o_orderdate as date)""",
    "v_alerts": """
        select concat('al-', o_orderkey) as id, cast(c_nationkey + 1 as varchar(10)) as province_id,
               case when o_orderkey % 3 = 0 then 'HIGH' else 'MEDIUM' end as level,
               case o_orderkey % 4 when 0 then 'WILDFIRE' when 1 then 'FLOOD' else 'DROUGHT' end as risk_type,
               700 + o_orderkey % 500 as affected_policies, cast(floor(o_totalprice) as bigint) as estimated_loss_usd,
               cast(o_orderdate as date) as issued_at, o_orderkey % 5 <> 0 as active
        from orders join customer on o_custkey = c_custkey""",
    "v_notifications": """
        select concat('n', event_id) as id, concat('pf', user_id % 5) as portfolio_id,
               concat('a', user_id) as asset_id, 'wildfire_proximity' as type,
               case event_type when 'error' then 'HIGH' when 'click' then 'medium' when 'view' then 'Low'
                    when 'signup' then 'urgent' else null end as severity,
               props as payload, concat('key-', user_id, '-', cast(ts as date)) as dedup_key, ts as created_at,
               case when event_id % 4 = 0 then ts else null end as acknowledged_at
        from events""",
    "v_scores": """
        select concat('a', l_suppkey) as asset_id, cast(l_shipdate as date) as date,
               case l_linenumber % 5 when 0 then 'heat' when 1 then 'rain' when 2 then 'wind' when 3 then 'drought'
                    else 'wildfire' end as peril,
               max(cast(l_quantity * 2E0 as int)) as score
        from lineitem
        group by l_suppkey, cast(l_shipdate as date), l_linenumber % 5""",
    "v_score_bands": """
        select asset_id, date, peril, score,
               case when score >= 80 then 'Extreme' when score >= 60 then 'Major' when score >= 40 then 'Moderate'
                    when score >= 20 then 'Minor' else 'Minimal' end as band,
               concat(peril, ' reading ', score) as driver
        from v_scores""",
    # object listing, keys repeat
    "v_listing": """
        select 'open-bucket' as bucket,
               concat('e5.oper.an.sfc/', 2015 + p_partkey % 10,
                      case when p_partkey % 12 < 9 then '0' else '' end, 1 + p_partkey % 12,
                      '/e5.oper.an.sfc.128_', 165 + p_size % 7, '_', s.short, '.ll025sc.', 2015 + p_partkey % 10,
                      case when p_partkey % 12 < 9 then '0' else '' end, 1 + p_partkey % 12, '0100.nc') as key,
               cast(floor(p_retailprice * 100E0) as bigint) as size, concat('"', p_partkey % 9, 'tag"') as etag,
               p_partkey as arrival
        from part join (select 0 as k, '2t' as short union all select 1, '10u' union all select 2, '10v'
                        union all select 3, 'swvl1' union all select 4, 'tp' union all select 5, 'lsp'
                        union all select 6, 'cp') s on s.k = p_size % 7""",
    # the catalog that listing leads to
    "v_objects": """
        select bucket, key, size, replace(etag, '"', '') as etag, short,
               case short when '2t' then '2m_temperature' when '10u' then '10m_u_component_of_wind'
                    when '10v' then '10m_v_component_of_wind' when 'swvl1' then 'volumetric_soil_water_layer_1'
                    when 'tp' then 'total_precipitation' when 'lsp' then 'large_scale_precipitation'
                    else 'convective_precipitation' end as variable, year, month
        from (select 'open-bucket' as bucket, key, size, etag, short, year, month,
                     row_number() over (partition by key order by arrival desc) as rn
              from (select l.*, 2015 + p_partkey % 10 as year, 1 + p_partkey % 12 as month,
                           case p_size % 7 when 0 then '2t' when 1 then '10u' when 2 then '10v' when 3 then 'swvl1'
                                when 4 then 'tp' when 5 then 'lsp' else 'cp' end as short
                    from v_listing l join part on p_partkey = l.arrival) a) b
        where rn = 1""",
    "v_jobs": """
        select concat('j', o_orderkey) as job_id, o_custkey % 50 as backfill_id,
               case o_orderkey % 6 when 0 then 'queued' when 1 then 'running' when 2 then 'success'
                    when 3 then 'failed' when 4 then 'success_with_warnings' else 'fail_dq' end as status,
               case when o_orderkey % 2 = 0 then 'aws_nsf_ncar' else 'cds' end as provider,
               concat('sig', o_custkey % 200) as request_signature,
               cast(o_orderdate as timestamp) as created_at, cast(o_orderdate as timestamp) as started_at,
               case when o_orderkey % 3 = 0 then null else cast(o_orderdate as timestamp) end as finished_at,
               case when o_orderkey % 6 = 3 then 'boom' else null end as error,
               nullif((o_orderkey % 64) * 0.5E0, 0E0) as duration_seconds,
               cast(floor(o_totalprice) as bigint) as bytes_downloaded,
               substring(cast(o_orderdate as varchar(30)), 1, 7) as month,
               o_orderkey % 4 as raw_files, o_orderkey % 3 as feature_files
        from orders""",
    # one item per backfill and month, pointing at its newest job
    "v_items": """
        select backfill_id, month, case when month like '%-12' then 'none' else max(job_id) end as job_id,
               'queued' as status, case when backfill_id % 2 = 0 then 'aws' else 'cds' end as provider_selected,
               min(created_at) as created_at
        from v_jobs group by backfill_id, month""",
    "v_progress": """
        select month, case when sum(bytes_downloaded) % 4 = 0 then 'failed'
                           when sum(bytes_downloaded) % 4 = 1 then 'running' else 'success' end as status
        from v_jobs group by month""",
    # column-wise daily weather as JSON, one text per province and month
    "v_daily_json": """
        select province_id, month,
               concat('{"daily":{"time":[', times, '],"precipitation_sum":[', rains, '],"temperature_2m_max":[',
                      warm, ']}}') as json
        from (select province_id, substring(cast(date as varchar(10)), 1, 7) as month,
                     {list_times} as times, {list_rain} as rains, {list_warm} as warm
              from v_rain_readings group by province_id, substring(cast(date as varchar(10)), 1, 7)) t""",
}

# Where the two dialects differ: a day sequence, and joining a group's texts in order.
_FIRST_DAY = "(select cast(min(o_orderdate) as date) from orders)"
_LAST_DAY = "(select cast(max(o_orderdate) as date) from orders)"
_SPARK_LISTS = {
    "all_days": f"explode(sequence({_FIRST_DAY}, {_LAST_DAY}))",
    "list_times": """concat_ws(',', transform(array_sort(collect_list(date)), d -> concat('"', d, '"')))""",
    "list_rain": """concat_ws(',', transform(array_sort(collect_list(struct(date, rain))), s -> coalesce(cast(s.rain as string), 'null')))""",
    "list_warm": """concat_ws(',', transform(filter(array_sort(collect_list(date)), d -> day(d) <= 20), d -> cast(day(d) as string)))""",
}
_DUCK_LISTS = {
    "all_days": f"cast(unnest(generate_series({_FIRST_DAY}, {_LAST_DAY}, interval 1 day)) as date)",
    "list_times": """string_agg(concat('"', date, '"'), ',' order by date)""",
    "list_rain": """string_agg(coalesce(cast(rain as varchar), 'null'), ',' order by date)""",
    "list_warm": """string_agg(cast(day(date) as varchar), ',' order by date) filter (where day(date) <= 20)""",
}

_NAME = re.compile(r"\b([vx]_[a-z0-9_]+)\b")

# Steps shared by several SQL twins; filled by the query modules.
STEPS: dict[str, str] = {}


def _text(name: str, lists: dict[str, str]) -> str:
    text = VIEWS.get(name) or STEPS[name]
    for key, value in lists.items():
        text = text.replace("{" + key + "}", value)
    return text


def _needed(text: str, lists: dict[str, str]) -> list[str]:
    """Views a text needs, dependencies first."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name in _NAME.findall(t):
            if (name in VIEWS or name in STEPS) and name not in out:
                visit(_text(name, lists))
                out.append(name)

    visit(text)
    return out


def duck_sql(query: str) -> str:
    """Prefix a DuckDB query with the views it names."""
    names = _needed(query, _DUCK_LISTS)
    if not names:
        return query
    views = ",\n".join(f"{n} as ({_text(n, _DUCK_LISTS)})" for n in names)
    body = query.strip()
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"


class Tables:
    """The supplied tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"select * from {name}")
        raise AttributeError(name)

    def sql(self, query: str) -> DataFrame:
        names = _needed(query, _SPARK_LISTS)
        views = [(n, _text(n, _SPARK_LISTS)) for n in names]
        for base in BASE:
            if any(re.search(rf"\b(from|join)\s+{base}\b", t) for t in [query, *(t for _, t in views)]):
                getattr(self, base).createOrReplaceTempView(base)
        # views, not CTEs: numbered CTEs hide persisted frames from every plan that has others before them
        for name, text in views:
            self.spark.sql(text).createOrReplaceTempView(name)
        return self.spark.sql(query)
