"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import HOURLY_VARIABLES

CHECKED = ("temp_max", "precip_sum", "wind_max", "soil_moisture_mean")


def feature_dq(features: DataFrame) -> DataFrame:
    """One row: status, share of missing values per column, warnings."""
    stats = features.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_null_ratio") for c in CHECKED],
        *[F.min(c).alias(f"{c}_min") for c in CHECKED], *[F.max(c).alias(f"{c}_max") for c in CHECKED])

    def warn(test: Column, text: str, value: str) -> Column:
        return F.when(test, F.concat(F.lit(text), F.col(value).cast("string")))

    negative = (F.col("precip_sum_min") < 0) | (F.col("wind_max_min") < 0)
    warnings = F.array_compact(F.array(
        warn(F.col("temp_max_min") < -40, "temp_max below expected range: ", "temp_max_min"),
        warn(F.col("temp_max_max") > 60, "temp_max above expected range: ", "temp_max_max"),
        warn(F.col("precip_sum_min") < 0, "precip_sum negative: ", "precip_sum_min"),
        warn(F.col("wind_max_min") < 0, "wind_max negative: ", "wind_max_min"),
        warn(F.col("soil_moisture_mean_min") < 0, "soil_moisture below 0: ", "soil_moisture_mean_min"),
        warn(F.col("soil_moisture_mean_max") > 1, "soil_moisture above 1: ", "soil_moisture_mean_max")))
    status = (
        F.when(F.col("n") == 0, "fail").when(F.coalesce(negative, F.lit(False)), "fail_dq")
        .when(F.size("warnings") > 0, "success_with_warnings").otherwise("pass"))
    return stats.withColumn("warnings", warnings).select(
        status.alias("dq_status"), F.when(F.col("n") == 0, "empty_frame").alias("error"),
        *[f"{c}_null_ratio" for c in CHECKED], "warnings")


def ingest_dq_month(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """One report row per month of data.

    ``hourly``: month (YYYY-MM), time and the hourly variables.  ``daily``: month
    and daily features.  Distinct hours are counted after a first pass that
    reduces the readings to one row per hour.
    """
    per_hour = hourly.groupBy("month", "time").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(F.col(v).isNull(), 1)).alias(f"null_{v}") for v in HOURLY_VARIABLES])
    read = per_hour.groupBy("month").agg(
        F.count("time").alias("actual_hours"),
        *[(F.sum(f"null_{v}") / F.sum("n")).alias(f"nan_ratio_{v}") for v in HOURLY_VARIABLES])
    built = daily.groupBy("month").agg(
        (24 * (F.datediff(F.max("date"), F.min("date")) + 1)).cast("bigint").alias("expected_hours"),
        F.min("temp_mean").alias("temp_c_min"), F.max("temp_max").alias("temp_c_max"),
        F.min("precip_sum").alias("precip_min"))
    missing = F.greatest(
        F.lit(0.0), (F.col("expected_hours") - F.col("actual_hours")) / F.col("expected_hours"))
    return built.join(read, "month").select(
        "month", "expected_hours", "actual_hours", missing.alias("missing_ratio"),
        *[f"nan_ratio_{v}" for v in HOURLY_VARIABLES], "temp_c_min", "temp_c_max", "precip_min")


def ingest_dq_status(reports: DataFrame) -> DataFrame:
    """One verdict over all month reports."""
    def known(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    failed = (
        known(F.col("temp_c_min") < -80) | known(F.col("temp_c_max") > 60)
        | known(F.col("precip_min") < 0) | known(F.col("missing_ratio") > 0.2))
    return reports.agg(
        F.when(F.bool_or(failed), "fail").when(F.bool_or(known(F.col("missing_ratio") > 0.05)), "warn")
        .otherwise("pass").alias("dq_status"))


def points_dq_status(daily: DataFrame) -> DataFrame:
    """Verdict for a points ingest: negatives fail, absent soil moisture warns."""
    stats = daily.agg(F.min("precip_sum").alias("p"), F.min("wind_max").alias("w"),
                      F.count("soil_moisture_mean").alias("soil"))
    negative = F.coalesce(F.col("p") < 0, F.lit(False)) | F.coalesce(F.col("w") < 0, F.lit(False))
    dry = F.col("soil") == 0
    return stats.select(
        F.when(negative, "fail").when(dry, "warn").otherwise("pass").alias("dq_status"),
        F.array_compact(F.array(F.when(dry, "soil_moisture_missing"))).alias("warnings"))
