"""Input formats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import instant_literal
from ..functions.geo import wkt_point
from ..functions.numbers import half_even, number
from ..operators.filters import filter_bbox, filter_date_range, filter_interval_overlap


def stored_features(spark: SparkSession, root: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Rows of the ``year=/month=`` folders a date range touches.

    The folder condition is on the folder names alone, so other months are
    neither listed for reading nor opened.  Folders are whole months: clip by
    date afterwards.
    """
    first, last = str(start)[:7], str(end)[:7]
    files = spark.read.option("mergeSchema", "true").parquet(root)
    number = F.col("year").cast("int") * 12 + F.col("month").cast("int")
    return files.where(number.between(int(first[:4]) * 12 + int(first[5:7]), int(last[:4]) * 12 + int(last[5:7])))


def read_feature_files(spark: SparkSession, root: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """``stored_features`` with ``file_id`` and ``written_at`` of each row's
    file, for unit rules (which so still see whole files) and newest-wins."""
    return stored_features(spark, root, start, end).select(
        "*", F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_modification_time").alias("written_at"))


def feature_ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row per feature file below ``root``: uri, start_date, end_date, row_count.

    Kept as a table, it is the interval index that ``read_ledger_files`` asks.
    """
    return spark.read.parquet(root).groupBy(F.col("_metadata.file_path").alias("uri")).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("row_count"))


def read_ledger_files(spark: SparkSession, root: str, ledger: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Rows of the ledger's files whose days overlap the range; no other file is listed or opened.

    Whole files are returned, for unit rules; the range's file names pass through the driver,
    as every scan's do.
    """
    uris = sorted(r["uri"] for r in filter_interval_overlap(ledger, start, end).select("uri").collect())
    if not uris:
        return spark.read.parquet(root).where(F.lit(False))
    return spark.read.option("basePath", root).parquet(*uris)


def read_fire_csv(spark: SparkSession, path: str) -> DataFrame:
    """Detection CSV files with a header; every column as text."""
    return spark.read.option("header", "true").option("inferSchema", "false").csv(path)


def _text(df: DataFrame, *names: str) -> Column:
    """First of the named columns the file has; empty text is missing."""
    for name in names:
        if name in df.columns:
            return F.nullif(F.trim(F.col(name)), F.lit(""))
    return F.lit(None).cast("string")


def fire_time(df: DataFrame) -> Column:
    """Detection instant: date with HHMM, else the date, else an ISO column."""
    day, clock = _text(df, "acq_date"), _text(df, "acq_time")
    padded = F.when(F.length(clock) <= 4, F.lpad(clock, 4, "0"))
    tries = [
        F.try_to_timestamp(F.concat_ws(" ", day, padded), F.lit("yyyy-M-d HHmm")),
        F.try_to_timestamp(day, F.lit("yyyy-M-d")),
    ]
    tries += [_text(df, name).try_cast("timestamp") for name in ("time_utc", "datetime", "acq_datetime")]
    return F.coalesce(*tries)


def fire_csv_normalize(raw: DataFrame, bbox: tuple[float, float, float, float], start: dt.date | str,
                       end: dt.date | str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Text detections to fire rows inside a box (north, west, south, east) and
    a date range.  Rows without a usable position or time are skipped; a bad
    radiative power becomes NULL."""
    satellite = F.coalesce(_text(raw, "satellite"), _text(raw, "instrument"))
    read = F.struct(
        fire_time(raw).alias("time_utc"),
        number(_text(raw, "latitude", "lat")).alias("lat"), number(_text(raw, "longitude", "lon")).alias("lon"),
        number(_text(raw, "frp")).alias("frp"), _text(raw, "confidence").alias("confidence"),
        satellite.alias("satellite"), *extra)
    # filters do not pass a generator: below it each would read the texts again
    rows = raw.select(read.alias("_read")).select(F.inline(F.array("_read")))
    north, west, south, east = bbox
    inside = filter_bbox(rows.where(F.col("time_utc").isNotNull()), north, west, south, east, "lat", "lon")
    dated = filter_date_range(inside.withColumn("_day", F.to_date("time_utc")), start, end, "_day").drop("_day")
    return dated.withColumns({
        "lat_round": half_even(F.col("lat"), 4), "lon_round": half_even(F.col("lon"), 4),
        "geom_wkt": wkt_point(F.col("lat"), F.col("lon")),
    })


# Field names of the column-wise daily JSON.
DAILY_JSON = (
    "daily struct<time: array<string>, temperature_2m_mean: array<double>, "
    "temperature_2m_max: array<double>, precipitation_sum: array<double>, wind_speed_10m_max: array<double>>"
)
DAILY_FIELDS = {
    "temp_mean": "temperature_2m_mean",
    "temp_max": "temperature_2m_max",
    "precip_sum": "precipitation_sum",
    "wind_max": "wind_speed_10m_max",
}


def daily_json_to_rows(df: DataFrame, json_column: str, keys: list[str]) -> DataFrame:
    """Column-wise JSON arrays to rows; short or absent arrays give NULLs."""
    daily = F.from_json(F.col(json_column), DAILY_JSON)["daily"]
    parsed = df.select(*keys, daily.alias("d")).where(F.col("d.time").isNotNull())

    def row(day: Column, i: Column) -> Column:
        return F.struct(
            F.to_date(day).alias("date"),
            *[F.get(F.coalesce(F.col(f"d.{field}"), F.array().cast("array<double>")), i).alias(name)
              for name, field in DAILY_FIELDS.items()],
            F.lit(None).cast("double").alias("soil_moisture_mean"), F.lit("open-meteo").alias("source"))

    return parsed.select(*keys, F.inline(F.transform("d.time", row)))


def daily_json_rain(df: DataFrame, json_column: str, keys: list[str]) -> DataFrame:
    """The ordered rain readings of a daily JSON, missing ones as 0.0."""
    rain = F.from_json(F.col(json_column), DAILY_JSON)["daily"]["precipitation_sum"]
    filled = F.transform(F.coalesce(rain, F.array().cast("array<double>")), lambda v: F.coalesce(v, F.lit(0.0)))
    return df.select(*keys, filled.alias("rain"))


def read_artifacts(spark: SparkSession, path: str, artifact_type: str, now: dt.datetime | str) -> DataFrame:
    """Files below a path with checksum and size, ready to append to the registry."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.lit(artifact_type).alias("artifact_type"), F.col("path").alias("uri"),
        F.sha2("content", 256).alias("checksum_sha256"), F.col("length").alias("byte_size"),
        F.lit(None).cast("string").alias("source_etag"), F.lit(False).alias("cache_hit"),
        instant_literal(now).alias("created_at"))


def object_checksum(etag: Column, key: Column) -> Column:
    """Checksum of an object that was only streamed: from its tag, else its key."""
    return F.sha2(F.coalesce(etag, key), 256)

