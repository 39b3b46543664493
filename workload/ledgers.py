"""Object catalog, job ledger, backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.functions.dates import month_spine
from terrahaz.operators import catalog as ct
from terrahaz.operators import filters as fl
from terrahaz.operators import ledgers as lg
from terrahaz.session import shared_folder
from terrahaz.sources import readers, sinks

from .common import LEDGER_NOW, plain, stored
from .views import STEPS, Tables

MONTHS = ("2015-01", "2016-12")
JOB_MONTHS = ("1995-01", "2001-12")
CORE = list(ct.CORE_VARIABLES)


def _signed(t: Tables) -> DataFrame:
    """Two requests per customer and month that differ in list order only."""
    base = t.v_jobs.select("job_id", "created_at", "backfill_id", "month", "provider").withColumn("bbox", F.array(
        F.lit(42.00001), F.lit(26.0), F.lit(36.0), F.lit(45.0)))
    one = base.withColumn("variables", F.array(F.lit("tp"), F.lit("2t")))
    two = base.withColumns({"variables": F.array(F.lit("2t"), F.lit("tp")), "job_id": F.concat("job_id", F.lit("b"))})
    return lg.request_dedupe(one.unionByName(two), ["backfill_id", "month", "provider", "variables", "bbox"],
                             ["created_at", "job_id"], ("variables",), ("bbox",))


def _stored_catalog(t: Tables) -> DataFrame:
    old = t.v_objects.select("bucket", "key", (F.col("size") + 1).alias("size"), F.lit("old").alias("etag"),
                             F.lit(None).cast("string").alias("last_modified"))
    gone = old.withColumn("key", F.concat(F.lit("other/"), F.col("key")))
    return ct.object_listing_parse(old.unionByName(gone))


def _upsert_catalog(t: Tables) -> DataFrame:
    listing = t.v_listing.withColumn("last_modified", F.lit("2024-01-01"))
    table = stored(t.spark, "object-catalog", _stored_catalog(t), "year", "month")
    sinks.store_object_catalog(table, listing, "arrival")
    return table.read().select("key", "size", "etag", "variable", "year")


def _artifacts(t: Tables) -> DataFrame:
    """Lineage rows of streamed objects."""
    return t.v_objects.select(
        F.lit("raw_nc").alias("artifact_type"), F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key").alias("source_uri"),
        F.col("etag").alias("source_etag"), readers.object_checksum(F.col("etag"), F.col("key")).alias("checksum_sha256"),
        F.col("size").alias("byte_size"), F.lit(False).alias("cache_hit"))


def _artifact_files(t: Tables) -> DataFrame:
    """Registry rows of files the job wrote itself."""
    path = shared_folder(t.spark, "artifacts")
    sinks.progress_snapshot_sink(t.v_progress, path)
    files = readers.read_artifacts(t.spark, f"{path}/*.json", "progress_json", LEDGER_NOW)
    return plain(files.select("artifact_type", "checksum_sha256", "byte_size", "cache_hit", "created_at"))


def _status(t: Tables) -> DataFrame:
    runs = t.v_jobs.where("status = 'queued'").select(
        F.col("job_id").alias("run_id"), F.lit("success").alias("status"), "started_at", "finished_at")
    backfills = t.v_jobs.where("status in ('queued', 'running')").select(
        F.col("job_id").alias("backfill_id"), F.lit("finished").alias("status"), F.lit("aws_first_hybrid").alias("provider_strategy"),
        "created_at", "finished_at")
    fire_jobs = t.v_jobs.where("status in ('running', 'failed')").select("job_id", "status", "created_at", "started_at", "finished_at")
    return plain(lg.job_status_lookup(t.v_jobs.select("job_id"), runs, backfills, fire_jobs, t.v_jobs))


def _reuse(t: Tables) -> DataFrame:
    jobs = t.v_jobs.withColumns({
        "dataset": F.lit("era5-land"), "bbox_csv": F.lit("42,26,36,45"), "variables_csv": F.lit("2t,tp"),
        "start_date": F.to_date(F.concat("month", F.lit("-01"))), "end_date": F.last_day(F.to_date(F.concat("month", F.lit("-01"))))})
    months = month_spine(t.spark, *JOB_MONTHS).select(
        "month", "start_date", "end_date", F.when(F.col("month_no") % 2 == 0, "aws").otherwise("cds").alias("provider"))
    return lg.backfill_reuse_done(months, jobs, "era5-land", "42,26,36,45", "2t,tp")


def items(t: Tables) -> DataFrame:
    return lg.backfill_rollup(t.v_items, t.v_jobs)


def rollup(t: Tables) -> DataFrame:
    started = t.v_items.groupBy("backfill_id").agg(F.min("created_at").alias("created_at"))
    return lg.backfill_rollup_agg(items(t)).join(started, "backfill_id")


def summary(t: Tables) -> DataFrame:
    return lg.backfill_progress_summary(t.spark, t.v_progress, *JOB_MONTHS, "2000-12-31 00:00:00", LEDGER_NOW)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("failed_months", F.concat_ws(",", "failed_months"))


def _snapshot(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "progress")
    sinks.progress_snapshot_sink(_flat(summary(t)), path)
    return t.spark.read.schema(_flat(summary(t)).schema).json(path)


def _month_summary(t: Tables) -> DataFrame:
    objects = t.v_objects.select(F.format_string("%04d-%02d", F.col("year").cast("int"), F.col("month").cast("int")).alias("month"),
                                 "size", (F.col("size") % 2 == 0).alias("cache_hit"))
    daily = t.v_listing.select(F.regexp_replace(F.regexp_extract("key", r"/e5.*\.(\d{6})01", 1), r"(\d{4})(\d{2})", "$1-$2").alias("month"))
    return lg.month_ingest_summary(objects, daily)


_STATUS = """
    select job_id, created_at, started_at, finished_at, status, provider,
           case when status in ('queued') then 0 when status = 'running' then 1 when status = 'failed' then 2 else 3 end as led
    from v_jobs"""
_LABEL = "printf('%04d-%02d', year, month)"
_FORMS = "(v.variable = o.variable or (v.variable = 'total_precipitation' and o.variable in ('large_scale_precipitation', 'convective_precipitation')))"
_CORE_ROWS = "(values " + ", ".join(f"('{v}', {i})" for i, v in enumerate(CORE)) + ")"

STEPS.update({
    "x_month_spine": f"""
        select strftime(m, '%Y-%m') as month, cast(m as date) as start_date, last_day(m) as end_date
        from generate_series(timestamp '{MONTHS[0]}-01', timestamp '{MONTHS[1]}-01', interval 1 month) g(m)""",
    "x_job_spine": f"""
        select strftime(m, '%Y-%m') as month, cast(m as date) as start_date, last_day(m) as end_date, month(m) as mn
        from generate_series(timestamp '{JOB_MONTHS[0]}-01', timestamp '{JOB_MONTHS[1]}-01', interval 1 month) g(m)""",
    "x_month_have": f"""
        select {_LABEL} as month, list(distinct variable) as have from v_objects group by year, month""",
    "x_rollup": """
        select backfill_id, count(*) as months_total, count(*) filter (where ok) as months_success, count(*) filter (where bad) as months_failed,
               coalesce(string_agg(month, ',' order by month) filter (where bad), '') as failed_months,
               case when not bool_and(ok or bad) then 'running' when count(*) filter (where bad) > 0 then 'failed' else 'success' end as status,
               min(created_at) as created_at
        from (select i.*, coalesce(j.status in ('success', 'success_with_warnings'), false) as ok,
                     coalesce(j.status in ('failed', 'fail_dq'), false) as bad
              from v_items i left join v_jobs j on j.job_id = i.job_id) t group by backfill_id""",
    "x_summary": """
        select count(*) as total_months, count(*) filter (where status = 'success') as completed,
               count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'running') as running,
               coalesce(string_agg(s.month, ',' order by s.month) filter (where status = 'failed'), '') as failed_months
        from x_job_spine s left join v_progress p on p.month = s.month""",
})

QUERIES = {
    "object_listing_parse": lambda t: ct.object_listing_parse(t.v_listing).select(
        "arrival", "key", "dataset_group", "variable", "year", "month", "day"),
    "upsert_object_catalog": _upsert_catalog,
    "artifact_registry": _artifacts,
    "artifact_registry_files": _artifact_files,
    "variable_in_list": lambda t: fl.variable_in_list(t.v_objects, ["2m_temperature", "total_precipitation"]).select("key", "variable"),
    "pending_months": lambda t: plain(lg.pending_months(t.spark, *JOB_MONTHS, t.v_progress)),
    "resolve_month_provider": lambda t: plain(ct.resolve_month_provider(t.spark, t.v_objects, *MONTHS, CORE)),
    "backfill_reuse_done": _reuse,
    "backfill_rollup": lambda t: plain(items(t)),
    "job_status_lookup": _status,
    "latest_pipeline_run": lambda t: lg.latest_pipeline_run(t.v_jobs.select(
        F.col("job_id").alias("run_id"), "status", F.col("bytes_downloaded").alias("rows_written"), "started_at")),
    "month_objects": lambda t: ct.month_objects(t.v_objects, 2016, 2, CORE),
    "month_variables": lambda t: ct.month_variables(t.v_objects, 2016, 2),
    "catalog_latest": lambda t: ct.catalog_latest(t.v_objects),
    "missing_variables": lambda t: t.v_objects.groupBy("year", "month").agg(F.collect_set("variable").alias("have")).select(
        "year", "month", F.concat_ws(",", ct.missing_variables(CORE, F.col("have"))).alias("missing")),
    "job_metrics": lambda t: lg.job_metrics(t.v_jobs, LEDGER_NOW, 24 * 365),
    "backfill_rollup_agg": lambda t: _flat(lg.backfill_rollup_agg(items(t))),
    "backfill_eta": lambda t: lg.backfill_eta(rollup(t), LEDGER_NOW),
    "backfill_progress_summary": lambda t: _flat(summary(t)),
    "progress_snapshot_sink": _snapshot,
    "month_ingest_summary": _month_summary,
    "newest_match": lambda t: plain(lg.newest_match(t.v_jobs).select("request_signature", "job_id", "status", "created_at")),
    "request_dedupe": lambda t: plain(_signed(t).select("job_id", "backfill_id", "month", "provider")),
    "stale_jobs": lambda t: plain(lg.stale_jobs(t.v_jobs, "1998-07-01 00:10:00").select("job_id", "status", "error", "finished_at")),
}

ORACLES = {
    "object_listing_parse": """
        select arrival, key, 'e5.oper.an.sfc' as dataset_group,
               case p_size % 7 when 0 then '2m_temperature' when 1 then '10m_u_component_of_wind' when 2 then '10m_v_component_of_wind'
                    when 3 then 'volumetric_soil_water_layer_1' when 4 then 'total_precipitation' when 5 then 'large_scale_precipitation'
                    else 'convective_precipitation' end as variable, cast(2015 + p_partkey % 10 as int) as year,
               cast(1 + p_partkey % 12 as int) as month, 1 as day
        from v_listing join part on p_partkey = arrival""",
    "upsert_object_catalog": """
        select key, size, etag, variable, cast(year as int) as year from v_objects union all
        select concat('other/', key), size + 1, 'old', cast(null as varchar), cast(null as int) from v_objects""",
    "artifact_registry": """
        select 'raw_nc' as artifact_type, concat('s3://', bucket, '/', key) as source_uri, etag as source_etag,
               sha256(etag) as checksum_sha256, size as byte_size, false as cache_hit from v_objects""",
    "variable_in_list": """
        select key, variable from v_objects
        where variable in ('2m_temperature', 'total_precipitation', 'large_scale_precipitation', 'convective_precipitation')""",
    "pending_months": """
        select month, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date from x_job_spine
        where month not in (select month from v_progress where status = 'success')""",
    "resolve_month_provider": f"""
        with m as (select s.month, s.start_date, s.end_date, coalesce(h.have, []) as have from x_month_spine s left join x_month_have h using (month)),
        lack as (select m.month, string_agg(v.variable, ',' order by v.i) as missing
                 from m join {_CORE_ROWS} v(variable, i) on not (list_contains(have, v.variable)
                   or (v.variable = 'total_precipitation' and list_contains(have, 'large_scale_precipitation') and list_contains(have, 'convective_precipitation')))
                 group by m.month)
        select month, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date,
               case when missing is null then 'aws' else 'cds' end as provider,
               case when missing is null then 'all_vars_available' else concat('missing_vars=', missing) end as reason
        from m left join lack using (month)""",
    "backfill_reuse_done": """
        with j as (select month, provider, arg_max(job_id, (created_at, job_id)) as job_id, arg_max(status, (created_at, job_id)) as status
                   from v_jobs where status in ('success', 'success_with_warnings') and raw_files > 0 and feature_files > 0 group by month, provider)
        select s.month, j.job_id, coalesce(j.status, 'queued') as status from x_job_spine s
        left join j on j.month = s.month and j.provider = case when s.mn % 2 = 0 then 'aws_nsf_ncar' else 'cds' end""",
    "backfill_rollup": """
        select i.backfill_id, i.month, i.job_id, i.provider_selected, coalesce(j.status, i.status) as status, j.error,
               cast(j.finished_at as varchar) as finished_at, j.job_id is not null as job_known
        from v_items i left join v_jobs j on j.job_id = i.job_id""",
    "job_status_lookup": f"""
        select job_id, case led when 0 then 'success' when 1 then 'success' else status end as status,
               case led when 0 then 'aws_era5_catalog_sync' when 1 then 'aws_era5_backfill' when 2 then 'firms_ingest'
                    else case when provider = 'aws_nsf_ncar' then 'aws_era5_ingest' else 'era5_ingest' end end as type,
               cast(case when led = 0 then started_at else created_at end as varchar) as created_at,
               cast(case when led = 1 then finished_at else coalesce(finished_at, started_at) end as varchar) as updated_at
        from ({_STATUS}) t""",
    "latest_pipeline_run": """
        select job_id as run_id, status as run_status, bytes_downloaded as rows_written from v_jobs order by started_at desc, job_id desc limit 1""",
    "month_objects": f"""
        select key, variable from v_objects where year = 2016 and month = 2""",
    "month_variables": "select distinct variable from v_objects where year = 2016 and month = 2",
    "catalog_latest": f"""
        with l as (select v.variable, max({_LABEL}) as latest_month from {_CORE_ROWS} v(variable, i) left join v_objects o on {_FORMS} group by v.variable)
        select variable, latest_month, (select case when count(latest_month) = count(*) then min(latest_month) end from l) as latest_common_month from l""",
    "missing_variables": f"""
        with m as (select year, month, list(distinct variable) as have from v_objects group by year, month)
        select year, month, coalesce(string_agg(v.variable, ',' order by v.i), '') as missing
        from m left join {_CORE_ROWS} v(variable, i) on not (list_contains(have, v.variable)
          or (v.variable = 'total_precipitation' and list_contains(have, 'large_scale_precipitation') and list_contains(have, 'convective_precipitation')))
        group by year, month""",
    "job_metrics": f"""
        select count(*) as jobs, round_even(count(*) filter (where status in ('success', 'success_with_warnings')) / cast(count(*) as double), 4) as success_rate,
               round_even(avg(coalesce(duration_seconds, 0)), 2) as avg_duration, cast(sum(bytes_downloaded) as bigint) as bytes_downloaded
        from v_jobs where created_at >= timestamp '{LEDGER_NOW}' - interval 365 days""",
    "backfill_rollup_agg": "select backfill_id, months_total, months_success, months_failed, failed_months, status from x_rollup",
    "backfill_eta": f"""
        select backfill_id, round_even((months_success + months_failed) / cast(months_total as double) * 100E0, 2) as percent_done,
               case when months_success > 0 then round_even(greatest(months_total - months_success - months_failed, 0)
                    / (months_success / greatest(epoch(timestamp '{LEDGER_NOW}' - created_at) / 3600E0, 1E-6)), 2) end as eta_hours
        from x_rollup""",
    "backfill_progress_summary": """
        select total_months, completed, failed, running, round_even(completed / cast(total_months as double) * 100E0, 2) as percent_done, failed_months,
               case when completed > 0 then round_even(greatest(total_months - completed - failed, 0) / (completed / 24E0), 2) end as eta_hours
        from x_summary""",
    "month_ingest_summary": f"""
        with o as (select {_LABEL} as month, count(*) as objects_selected, cast(sum(size) as bigint) as raw_bytes,
                          count(*) filter (where size % 2 = 0) as cache_hits from v_objects group by year, month),
        d as (select printf('%04d-%02d', 2015 + p_partkey % 10, 1 + p_partkey % 12) as month, count(*) as n from part group by 1)
        select o.month, objects_selected, raw_bytes, cache_hits, coalesce(n, 0) as row_count from o left join d using (month)""",
    "newest_match": """
        select request_signature, job_id, status, cast(created_at as varchar) as created_at from (
          select *, row_number() over (partition by request_signature order by created_at desc, job_id desc) as rn
          from v_jobs where status in ('queued', 'running', 'success')) t where rn = 1""",
    "request_dedupe": """
        select job_id, backfill_id, month, provider from (
          select *, row_number() over (partition by backfill_id, month, provider order by created_at, job_id) as rn from v_jobs) t where rn = 1""",
    "stale_jobs": """
        with s as (select *, status in ('queued', 'running') and created_at < timestamp '1998-07-01 00:10:00' - interval 30 minutes as stale from v_jobs)
        select job_id, case when stale then 'failed' else status end as status,
               case when stale then 'manual stale recovery' else error end as error,
               cast(case when stale then timestamp '1998-07-01 00:10:00' else finished_at end as varchar) as finished_at from s""",
}
ORACLES["progress_snapshot_sink"] = ORACLES["backfill_progress_summary"]
