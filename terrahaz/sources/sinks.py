"""Writing results.

Tables that only grow are Parquet folders; a climatology version is replaced by
dynamic partition overwrite.  Tables that change are versioned (``versions``):
the partitions a change touches are written beside the old ones and a pointer is
switched last, so a job that dies leaves the old data in place.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import day_literal
from ..operators.catalog import object_listing_parse, upsert_object_catalog
from ..operators.features import CELL, keep_newest
from ..operators.notices import ack_notification
from .versions import VersionedTable, spread

BUCKETS = 64


def sink_features_month(features: DataFrame, path: str, mode: str = "append") -> None:
    dated = features.withColumns({"year": F.year("date"), "month": F.month("date")})
    spread(dated, ["year", "month"], [*CELL, "date"]).write.mode(mode).partitionBy("year", "month").parquet(path)


def sink_features_day(features: DataFrame, path: str, mode: str = "append") -> None:
    dated = features.withColumns({"year": F.year("date"), "month": F.month("date"), "day": F.dayofmonth("date")})
    spread(dated, ["year", "month", "day"], CELL).write.mode(mode).partitionBy("year", "month", "day").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *columns: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def sink_climatology(thresholds: DataFrame, path: str, level: str) -> None:
    """Replace a version.  The folder is the version alone, so a rebuild also
    clears the version's other level."""
    key = "month" if level == "month" else "doy"
    rows = thresholds.withColumn("level", F.lit(level)).withColumnRenamed(key, "period")
    overwrite_partitions(spread(rows, ["climatology_version"], ["cell_lat", "cell_lng", "period"]), path, "climatology_version")


def read_climatology(spark, path: str, level: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("level") == level)
    return rows.withColumnRenamed("period", "month" if level == "month" else "doy").drop("level")


def sink_scores_replace(stored: DataFrame, fresh: DataFrame, assets: DataFrame, start: dt.date | str,
                        end: dt.date | str, version: str) -> DataFrame:
    """Score table after a run: rows of the run's assets, dates and version go,
    the fresh rows come."""
    span = F.col("date").between(day_literal(start), day_literal(end)) & (F.col("climatology_version") == version)
    doomed = assets.select("asset_id").distinct().withColumn("_hit", F.lit(True))
    kept = stored.join(doomed, "asset_id", "left").where(~(span & F.coalesce("_hit", F.lit(False)))).drop("_hit")
    return kept.unionByName(fresh.select(*stored.columns))


def with_month(rows: DataFrame, date: str) -> DataFrame:
    """Adds ``month_no``, the partition of tables that change by day: few folders, however long the range."""
    return rows.withColumn("month_no", F.year(date) * 12 + F.month(date) - 1)


def scores_table(rows: DataFrame, path: str) -> VersionedTable:
    """Score table for rows like these, kept by version and month."""
    schema = with_month(rows.limit(0), "date").schema
    return VersionedTable(rows.sparkSession, path, schema, ["climatology_version", "month_no"], ("date", "asset_id"))


def write_scores(table: VersionedTable, fresh: DataFrame, assets: DataFrame, start: dt.date | str,
                 end: dt.date | str, version: str) -> None:
    """Replace scores: only the months of this run and version are read and
    written, once; a day that has no row any more is simply not written again."""
    first, last = ((d.year * 12 + d.month - 1) for d in (dt.date.fromisoformat(str(x)[:10]) for x in (start, end)))
    span = F.col("month_no").between(first, last) & (F.col("climatology_version") == version)
    table.replace(sink_scores_replace(table.read(span), with_month(fresh, "date"), assets, start, end, version), span)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Table after an upsert: per key the last incoming row, else the stored one."""
    last = keep_newest(incoming, keys, [F.col(arrival).desc()]).drop(arrival)
    kept = stored.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.select(*stored.columns))


def upsert_portfolio_assets(stored: DataFrame, incoming: DataFrame, arrival: str) -> DataFrame:
    return upsert(stored, incoming, ["portfolio_id", "asset_id"], arrival)


def upsert_daily_scores(stored: DataFrame, incoming: DataFrame, arrival: str) -> DataFrame:
    return upsert(stored, incoming, ["province_id", "as_of_date"], arrival)


def replace_active_alerts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Alert table after a refresh: inactive history stays, active rows are new."""
    return stored.where(~F.col("active")).unionByName(fresh.select(*stored.columns))


def bucket_of(*keys: str) -> Column:
    """Partition of a table that is looked up by key: few folders, however many keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def with_bucket(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.withColumn("bucket_no", bucket_of(*keys))


def store_portfolio_assets(table: VersionedTable, incoming: DataFrame, arrival: str) -> None:
    """Upsert into a table kept by ``bucket_no`` of the portfolio."""
    table.merge(with_bucket(incoming, "portfolio_id"), lambda stored, new: upsert_portfolio_assets(stored, new, arrival))


def store_daily_scores(table: VersionedTable, incoming: DataFrame, arrival: str) -> None:
    """Upsert into a table kept by ``month_no`` of ``as_of_date``."""
    table.merge(with_month(incoming, "as_of_date"), lambda stored, new: upsert_daily_scores(stored, new, arrival))


def store_object_catalog(table: VersionedTable, listing: DataFrame, arrival: str) -> None:
    """Upsert into a table kept by year and month, which an object's key tells."""
    usable = object_listing_parse(listing.where(F.coalesce(F.col("key"), F.lit("")) != ""))
    table.merge(usable, lambda stored, new: upsert_object_catalog(stored, new, arrival))


def store_active_alerts(table: VersionedTable, fresh: DataFrame) -> None:
    """Refresh of a table kept by ``active``: the history's files are not touched."""
    table.replace(fresh, F.col("active"))


def store_acks(table: VersionedTable, acked: DataFrame, now: dt.datetime | str) -> None:
    """Acknowledge ids in a table kept by ``day``: only the days that hold one are rewritten."""
    hit = table.read().join(acked.select("id").distinct(), "id", "left_semi").persist()
    try:
        only = table.touched(hit)
        table.replace(ack_notification(table.read(only), hit, now), only)
    finally:
        hit.unpersist()


def export_portfolio_csv(rows: DataFrame, path: str) -> None:
    """CSV parts with a header, ordered by asset."""
    rows.orderBy("asset_id").write.mode("overwrite").option("header", "true").csv(path)


def progress_snapshot_sink(summary: DataFrame, path: str) -> None:
    """The one-row progress summary as JSON."""
    summary.write.mode("overwrite").json(path)
