"""Ingest-job ledger, backfills and progress."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import instant_literal, month_spine
from ..functions.numbers import half_even
from .features import keep_newest

# Status groups of the ledger.
DONE = ("success", "success_with_warnings")
BROKEN = ("failed", "fail_dq")
WAITING = ("queued", "running")


def _hours_before(now: dt.datetime | str, hours: float) -> Column:
    return instant_literal(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(hours * 60)))


def request_signature(fields: list[str], lists: tuple[str, ...] = (), boxes: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the request as JSON with sorted keys, sorted lists and
    four-decimal boxes: equal requests get equal signatures."""
    def value(name: str) -> Column:
        if name in lists:
            return F.sort_array(name)
        if name in boxes:
            return F.transform(F.col(name), lambda x: F.bround(x, 4))
        return F.col(name)

    return F.sha2(F.to_json(F.struct(*[value(f).alias(f) for f in sorted(fields)]),
                            {"ignoreNullFields": "false"}), 256)


def request_dedupe(requests: DataFrame, fields: list[str], order: list[str],
                   lists: tuple[str, ...] = (), boxes: tuple[str, ...] = ()) -> DataFrame:
    """First request of every signature."""
    signed = requests.withColumn("request_signature", request_signature(fields, lists, boxes))
    return keep_newest(signed, ["request_signature"], [F.col(c) for c in order])


def newest_match(jobs: DataFrame) -> DataFrame:
    """Newest live or finished job per signature."""
    live = jobs.where(F.col("status").isin("queued", "running", "success"))
    return keep_newest(live, ["request_signature"], [F.col("created_at").desc(), F.col("job_id").desc()])


def stale_jobs(jobs: DataFrame, now: dt.datetime | str, minutes: int = 30) -> DataFrame:
    """The ledger with jobs that waited too long marked failed."""
    moment = instant_literal(now)
    stale = F.col("status").isin(*WAITING) & (
        F.col("created_at") < moment - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return jobs.withColumns({
        "finished_at": F.when(stale, moment).otherwise(F.col("finished_at")),
        "error": F.when(stale, F.lit("manual stale recovery")).otherwise(F.col("error")),
        "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")),
    })


def job_metrics(jobs: DataFrame, now: dt.datetime | str, hours: float = 24) -> DataFrame:
    recent = jobs.where(F.col("created_at") >= _hours_before(now, hours))
    total = F.count(F.lit(1))
    done = F.count(F.when(F.col("status").isin(*DONE), 1))
    return recent.agg(
        total.alias("jobs"),
        F.coalesce(half_even(F.try_divide(done, total), 4), F.lit(0.0)).alias("success_rate"),
        F.coalesce(half_even(F.avg(F.coalesce("duration_seconds", F.lit(0.0))), 2), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.sum("bytes_downloaded"), F.lit(0)).cast("bigint").alias("bytes_downloaded"))


def fire_metrics(fires: DataFrame, notifications: DataFrame, jobs: DataFrame, now: dt.datetime | str,
                 hours: float = 24) -> DataFrame:
    """Counts of the last hours (each input has ``created_at``), as one row."""
    since = _hours_before(now, hours)
    tagged = [df.where(F.col("created_at") >= since).select(F.lit(name).alias("kind"))
              for name, df in (("fires", fires), ("alerts", notifications), ("jobs", jobs))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).agg(*[
        F.count(F.when(F.col("kind") == k, 1)).alias(name)
        for k, name in (("fires", "fires_ingested"), ("alerts", "alerts_generated"), ("jobs", "firms_jobs"))])


def latest_pipeline_run(runs: DataFrame) -> DataFrame:
    """Newest run; one row even when there is none."""
    newest = runs.agg(F.max_by(F.struct("run_id", "status", "rows_written"),
                               F.struct("started_at", "run_id")).alias("r"))
    return newest.select(
        F.col("r.run_id").alias("run_id"), F.coalesce("r.status", F.lit("unknown")).alias("run_status"),
        F.coalesce("r.rows_written", F.lit(0)).alias("rows_written"))


def job_status_lookup(job_ids: DataFrame, catalog_runs: DataFrame, backfills: DataFrame,
                      fire_jobs: DataFrame, ingest_jobs: DataFrame) -> DataFrame:
    """Status per id from the first ledger that knows it.

    Ids are matched before the ledgers are ranked.  Ledgers: (run_id|backfill_id|
    job_id), status, timestamps, and for backfills/jobs the provider columns.
    """
    def rows(df: DataFrame, key: str, rank: int, kind: Column, created: str, updated: Column) -> DataFrame:
        return df.join(job_ids.select(F.col("job_id").alias(key)).distinct(), key).select(
            F.col(key).alias("job_id"), F.lit(rank).alias("rank"), "status", kind.alias("type"),
            F.col(created).alias("created_at"), updated.alias("updated_at"))

    finished = F.coalesce("finished_at", "started_at")
    ledgers = [
        rows(catalog_runs, "run_id", 0, F.lit("aws_era5_catalog_sync"), "started_at", finished),
        rows(backfills.withColumn("status", F.when(F.col("status") == "finished", "success").otherwise(F.col("status"))),
             "backfill_id", 1,
             F.when(F.col("provider_strategy") == "aws_first_hybrid", "aws_era5_backfill").otherwise("era5_backfill"),
             "created_at", F.col("finished_at")),
        rows(fire_jobs, "job_id", 2, F.lit("firms_ingest"), "created_at", finished),
        rows(ingest_jobs, "job_id", 3,
             F.when(F.col("provider") == "aws_nsf_ncar", "aws_era5_ingest").otherwise("era5_ingest"),
             "created_at", finished),
    ]
    every = ledgers[0]
    for more in ledgers[1:]:
        every = every.unionByName(more)
    return keep_newest(every, ["job_id"], [F.col("rank")]).drop("rank")


def backfill_reuse_done(months: DataFrame, jobs: DataFrame, dataset: str, bbox_csv: str,
                        variables_csv: str) -> DataFrame:
    """Newest finished job that already covers a month; NULL where none does.

    ``months``: month, start_date, end_date, provider ("aws" or "cds").
    """
    usable = jobs.where(
        F.col("status").isin(*DONE) & (F.col("dataset") == dataset) & (F.col("bbox_csv") == bbox_csv)
        & (F.col("variables_csv") == variables_csv) & (F.col("raw_files") > 0) & (F.col("feature_files") > 0))
    best = usable.groupBy("provider", "start_date", "end_date").agg(
        F.max_by(F.struct("job_id", "status"), F.struct("created_at", "job_id")).alias("j"))
    wanted = months.withColumn("provider", F.when(F.col("provider") == "aws", "aws_nsf_ncar").otherwise("cds"))
    return wanted.join(best, ["provider", "start_date", "end_date"], "left").select(
        "month", F.col("j.job_id").alias("job_id"), F.coalesce("j.status", F.lit("queued")).alias("status"))


def backfill_rollup(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Backfill items with the current status of their jobs."""
    live = jobs.select("job_id", F.col("status").alias("job_status"), F.col("error").alias("job_error"),
                       F.col("finished_at").alias("job_finished_at"), F.lit(True).alias("job_known"))
    joined = items.join(live, "job_id", "left")
    known = F.coalesce("job_known", F.lit(False))
    return joined.select(
        "backfill_id", "month", "job_id", "provider_selected",
        F.when(known, F.col("job_status")).otherwise(F.col("status")).alias("status"),
        F.when(known, F.col("job_error")).alias("error"),
        F.when(known, F.col("job_finished_at")).alias("finished_at"), known.alias("job_known"))


def backfill_rollup_agg(rolled: DataFrame) -> DataFrame:
    """Counts, failed months and overall status per backfill.

    A backfill has one item per calendar month, so the list of failed months is
    bounded by the calendar.
    """
    known = F.col("job_known")
    ok = known & F.col("status").isin(*DONE)
    bad = known & F.col("status").isin(*BROKEN)
    out = rolled.groupBy("backfill_id").agg(
        F.count(F.lit(1)).alias("months_total"), F.count(F.when(ok, 1)).alias("months_success"),
        F.count(F.when(bad, 1)).alias("months_failed"),
        F.sort_array(F.collect_list(F.when(bad, F.col("month")))).alias("failed_months"),
        F.bool_and(ok | bad).alias("all_done"))
    return out.select(
        "backfill_id", "months_total", "months_success", "months_failed", "failed_months",
        F.when(~F.col("all_done"), "running").when(F.col("months_failed") > 0, "failed")
        .otherwise("success").alias("status"))


def _eta_hours(done: Column, remaining: Column, elapsed_hours: Column) -> Column:
    rate = done / F.greatest(elapsed_hours, F.lit(1e-6))
    return F.when(done > 0, half_even(F.greatest(remaining, F.lit(0)) / F.nullif(rate, F.lit(0.0)), 2))


def _hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 3600e6


def backfill_eta(rollup: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Percent done and hours left.  ``rollup`` carries ``created_at``."""
    ok, bad, total = F.col("months_success"), F.col("months_failed"), F.col("months_total")
    percent = F.when(total > 0, half_even((ok + bad) / F.nullif(total, F.lit(0)) * 100.0, 2)).otherwise(F.lit(0.0))
    elapsed = _hours_between(F.col("created_at"), instant_literal(now))
    return rollup.select("backfill_id", percent.alias("percent_done"),
                         _eta_hours(ok, total - ok - bad, elapsed).alias("eta_hours"))


def backfill_progress_summary(spark: SparkSession, progress: DataFrame, start_month: str, end_month: str,
                              started: dt.datetime | str, now: dt.datetime | str) -> DataFrame:
    """Progress over the requested months as one row."""
    months = month_spine(spark, start_month, end_month).select("month")
    state = months.join(progress.select("month", "status"), "month", "left")

    def count_of(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))

    sums = state.agg(
        F.count(F.lit(1)).alias("total_months"), count_of("success").alias("completed"),
        count_of("failed").alias("failed"), count_of("running").alias("running"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.col("month")))).alias("failed_months"))
    total, ok, bad = F.col("total_months"), F.col("completed"), F.col("failed")
    elapsed = _hours_between(instant_literal(started), instant_literal(now))
    return sums.select(
        "total_months", "completed", "failed", "running",
        F.when(total > 0, half_even(ok / F.nullif(total, F.lit(0)) * 100.0, 2)).otherwise(F.lit(100.0)).alias("percent_done"),
        "failed_months", _eta_hours(ok, total - ok - bad, elapsed).alias("eta_hours"))


def pending_months(spark: SparkSession, start_month: str, end_month: str, progress: DataFrame,
                   force: bool = False) -> DataFrame:
    months = month_spine(spark, start_month, end_month).select("month", "start_date", "end_date")
    if force:
        return months
    return months.join(progress.where(F.col("status") == "success").select("month"), "month", "left_anti")


def month_ingest_summary(objects: DataFrame, daily: DataFrame) -> DataFrame:
    """Per month: objects and bytes read, cache hits, feature rows written.

    ``objects``: month, size, cache_hit.  ``daily``: month.
    """
    read = objects.groupBy("month").agg(
        F.count(F.lit(1)).alias("objects_selected"), F.sum("size").cast("bigint").alias("raw_bytes"),
        F.count(F.when(F.col("cache_hit"), 1)).alias("cache_hits"))
    wrote = daily.groupBy("month").agg(F.count(F.lit(1)).alias("row_count"))
    return read.join(wrote, "month", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))


def page_order(key: str, ascending: bool, tie: list[str]) -> list[Column]:
    return [F.col(key).asc() if ascending else F.col(key).desc(), *[F.col(t).asc() for t in tie]]


def table_page(df: DataFrame, key: str, ascending: bool, page: int, per_page: int, tie: list[str]) -> DataFrame:
    """One page of a sorted table; ``tie`` makes the order full.

    ``offset`` + ``limit`` on a sort is planned as a bounded top-k, which suits
    the first pages.  Late pages of a large table are cheaper from ``store_ranges``.
    """
    return df.orderBy(*page_order(key, ascending, tie)).offset((page - 1) * per_page).limit(per_page)


def store_ranges(df: DataFrame, path: str, key: str, ascending: bool, tie: list[str]) -> None:
    """Writes the table in sorted ranges, one folder ``range_no`` each, for ``stored_page``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = page_order(key, ascending, tie)
    ranges = df.repartitionByRange(parts, *order).withColumn("range_no", F.spark_partition_id())
    ranges.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("range_no").parquet(path)


def stored_page(spark, path: str, key: str, ascending: bool, page: int, per_page: int, tie: list[str]) -> DataFrame:
    """One page, however late, from the ranges that hold it.

    The ranges' row counts (one number a range reaches the driver, read from file
    footers) tell which of them the page lies in; no other folder is opened and
    no task sorts more than those ranges.
    """
    table = spark.read.parquet(path)
    counts = sorted((r["range_no"], r["n"]) for r in table.groupBy("range_no").agg(F.count(F.lit(1)).alias("n")).collect())
    first, before, held, skip = (page - 1) * per_page, 0, [], 0
    for number, n in counts:
        if before + n > first and before < first + per_page:
            if not held:
                skip = first - before
            held.append(number)
        before += n
    chosen = table.where(F.col("range_no").isin(held)).drop("range_no")
    return chosen.orderBy(*page_order(key, ascending, tie)).offset(skip).limit(per_page)


def page_count(df: DataFrame, per_page: int) -> DataFrame:
    return df.agg(F.ceil(F.count(F.lit(1)) / per_page).alias("pages"))
