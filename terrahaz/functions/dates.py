"""Calendar helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def day_literal(value: dt.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def instant_literal(value: dt.datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp")


def end_of_day(day: Column) -> Column:
    """Last microsecond of a calendar day."""
    return (F.date_add(day, 1).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp")


def day_spine(spark: SparkSession, start: dt.date | str, end: dt.date | str) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(day_literal(start), day_literal(end))).alias("date"))


def month_spine(spark: SparkSession, start_month: str, end_month: str) -> DataFrame:
    """One row per month ``YYYY-MM`` from start to end, both included."""
    months = F.sequence(day_literal(f"{start_month}-01"), day_literal(f"{end_month}-01"),
                        F.expr("INTERVAL 1 MONTH"))
    return spark.range(1).select(F.explode(months).alias("start_date")).select(
        F.date_format("start_date", "yyyy-MM").alias("month"),
        "start_date",
        F.last_day("start_date").alias("end_date"),
        F.year("start_date").alias("year_no"),
        F.month("start_date").alias("month_no"),
    )


def month_chunks(spark: SparkSession, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """The months a date range touches, each clipped to the range."""
    spine = month_spine(spark, str(start)[:7], str(end)[:7])
    return spine.select(
        "month",
        F.greatest("start_date", day_literal(start)).alias("start_date"),
        F.least("end_date", day_literal(end)).alias("end_date"),
    )
