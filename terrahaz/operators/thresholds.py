"""Climatology: rolling sums, percentile thresholds, and their lookup."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import CELL
from .filters import filter_date_range
from .nearest import nearest_sites

# Threshold name -> (daily quantity, quantile).
THRESHOLDS = {
    "temp_max_p95": ("temp_max", 0.95),
    "wind_max_p95": ("wind_max", 0.95),
    "precip_1d_p95": ("precip_sum", 0.95),
    "precip_1d_p99": ("precip_sum", 0.99),
    "precip_7d_p95": ("precip_7d_sum", 0.95),
    "precip_7d_p99": ("precip_7d_sum", 0.99),
    "precip_30d_p10": ("precip_30d_sum", 0.10),
    "soil_moisture_p10": ("soil_moisture_mean", 0.10),
}
LEVELS = {"month": lambda c: F.month(c), "doy": lambda c: F.dayofyear(c)}


def cell_frame(rows: int, *also: str) -> "Window":
    """The current row and the rows before it, ``rows`` in all, of one cell."""
    return Window.partitionBy(*also, *CELL).orderBy("date").rowsBetween(1 - rows, 0)


def rolling_precip(features: DataFrame, *also: str) -> DataFrame:
    """7- and 30-row precipitation sums; a frame without any reading is NULL."""
    return features.withColumns({
        "precip_7d_sum": F.sum("precip_sum").over(cell_frame(7, *also)),
        "precip_30d_sum": F.sum("precip_sum").over(cell_frame(30, *also)),
    })


def build_climatology(features: DataFrame, start: dt.date | str, end: dt.date | str,
                      version: str, level: str = "month") -> DataFrame:
    """Thresholds per cell and month (or day of year) over the baseline.

    Exact interpolated percentiles.  A group holds one cell's days of one
    calendar month, so its size is bounded by the years of the baseline.

    Rows are spread once by a decimal form of the cell.  Decimals, unlike
    doubles, are recognised as the same key by window and grouping, so the
    percentile buffers never travel; the exact coordinates stay in the keys.
    """
    spread = ["_cell_lat", "_cell_lng"]
    keyed = filter_date_range(features, start, end).withColumns(
        {key: F.col(c).cast("decimal(15,9)") for key, c in zip(spread, CELL)}).repartition(*spread)
    rolled = rolling_precip(keyed, *spread)
    quantiles = [F.percentile(column, F.lit(q)).alias(name) for name, (column, q) in THRESHOLDS.items()]
    groups = rolled.withColumn("_period", LEVELS[level]("date").cast("int")).groupBy(*spread, *CELL, "_period").agg(*quantiles)
    return groups.select(
        F.lit(version).alias("climatology_version"), F.col("lat").alias("cell_lat"), F.col("lng").alias("cell_lng"),
        F.col("_period").alias(level), *THRESHOLDS)


def threshold_nearest(wanted: DataFrame, monthly: DataFrame) -> DataFrame:
    """For (lat, lng, month) rows: thresholds of the nearest cell that has that month."""
    values = list(THRESHOLDS)
    match = nearest_sites(
        wanted.select("lat", "lng", "month").distinct(),
        monthly.select("month", "cell_lat", "cell_lng").distinct(),
        {"lat": "cell_lat", "lng": "cell_lng"}, group=["month"])
    return match.join(monthly.select("month", "cell_lat", "cell_lng", *values),
                      ["month", "cell_lat", "cell_lng"]).select("lat", "lng", "month", *values)


def _per_cell(thresholds: DataFrame, level: str, name: str) -> DataFrame:
    """One row per cell holding a map from month (or day of year) to thresholds."""
    entry = F.struct(F.col(level).alias("key"), F.struct(*THRESHOLDS).alias("value"))
    return thresholds.groupBy("lat", "lng").agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def threshold_lookup(cell_days: DataFrame, monthly: DataFrame, daily: DataFrame | None,
                     version: str) -> DataFrame:
    """Append the eight thresholds that apply to each cell-day.

    Order of preference: same cell and day of year, same cell and month, nearest
    cell of that month; cell-days with none of them drop out.  Thresholds are
    folded to one row per cell (at most 12 + 366 entries), so the cell-days join
    on the cell alone and keep the partitioning of their windows.

    Runs one job: it lists the cell-months that lack thresholds of their own
    (normally none) and plans the nearest-cell search only if there are any.
    """
    def of_version(df: DataFrame) -> DataFrame:
        return df.where(F.col("climatology_version") == version).drop("climatology_version")

    monthly = of_version(monthly)
    exact = monthly.withColumnsRenamed({"cell_lat": "lat", "cell_lng": "lng"})
    asked = cell_days.select(*CELL, F.month("date").cast("int").alias("month")).distinct()
    open_months = asked.join(exact.select(*CELL, "month"), [*CELL, "month"], "left_anti").persist()
    resolved = exact.select(*CELL, "month", *THRESHOLDS)
    if not open_months.isEmpty():
        resolved = resolved.unionByName(threshold_nearest(open_months, monthly))
    out = cell_days.join(_per_cell(resolved, "month", "_by_month"), CELL, "left")
    chosen = F.try_element_at("_by_month", F.month("date").cast("int"))
    if daily is not None:
        by_day = of_version(daily).withColumnsRenamed({"cell_lat": "lat", "cell_lng": "lng"})
        out = out.join(_per_cell(by_day, "doy", "_by_doy"), CELL, "left")
        chosen = F.coalesce(F.try_element_at("_by_doy", F.dayofyear("date").cast("int")), chosen)
    out = out.withColumn("_t", chosen).where(F.col("_t").isNotNull())
    return out.select(*cell_days.columns, "_t.*")
