"""Daily features: naming, units, hourly-to-daily, newest-wins, point series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_literal, day_spine
from ..functions.numbers import number
from ..session import joins_by_measure
from .filters import filter_date_range, newest_first
from .nearest import nearest_sites
from .units import normalize_units

CELL = ["lat", "lng"]

# Canonical variable names and the short names they arrive under.
VARIABLE_ALIASES = {
    "t2m": "2m_temperature",
    "tp": "total_precipitation",
    "u10": "10m_u_component_of_wind",
    "v10": "10m_v_component_of_wind",
    "swvl1": "volumetric_soil_water_layer_1",
    "var_2t": "2m_temperature",
    "var_tp": "total_precipitation",
    "var_10u": "10m_u_component_of_wind",
    "var_10v": "10m_v_component_of_wind",
    "var_swvl1": "volumetric_soil_water_layer_1",
    "var_lsp": "large_scale_precipitation",
    "var_cp": "convective_precipitation",
}
COORDINATE_ALIASES = {"valid_time": "time", "latitude": "lat", "longitude": "lng", "lon": "lng"}
TEMPERATURE, PRECIP, WIND_U, WIND_V, SOIL = (
    "2m_temperature", "total_precipitation", "10m_u_component_of_wind",
    "10m_v_component_of_wind", "volumetric_soil_water_layer_1",
)
HOURLY_VARIABLES = (TEMPERATURE, PRECIP, WIND_U, WIND_V, SOIL)
FEATURE_VALUES = ("temp_mean", "temp_max", "precip_sum", "wind_max", "soil_moisture_mean")
SALTS = 64
SHARES = 16
LARGE_SCALE, CONVECTIVE = "large_scale_precipitation", "convective_precipitation"


def rename_aliases(observations: DataFrame) -> DataFrame:
    """Canonical column names and canonical values in ``variable``, any case."""
    renames = {old: new for old, new in COORDINATE_ALIASES.items()
               if old in observations.columns and new not in observations.columns}
    out = observations.withColumnsRenamed(renames)
    lowered = {c: VARIABLE_ALIASES[c.lower()] for c in out.columns
               if c.lower() in VARIABLE_ALIASES and VARIABLE_ALIASES[c.lower()] not in out.columns}
    out = out.withColumnsRenamed(lowered)
    if "variable" in out.columns:
        names = F.create_map(*[F.lit(x) for pair in VARIABLE_ALIASES.items() for x in pair])
        out = out.withColumn("variable", F.coalesce(names[F.lower("variable")], F.col("variable")))
    return out


def pivot_variables(long_hourly: DataFrame, variables: list[str] | None = None,
                    tie: str = "value") -> DataFrame:
    """Long to wide per (time, point).

    The first non-missing value wins; "first" is the lowest ``tie``.  One
    conditional aggregate per variable keeps this a single map-side-combined
    pass, where a discovered pivot would need an extra distinct job.
    """
    keys = ["time", "point_id", "lat", "lng"]
    present = F.col("value").isNotNull()
    return long_hourly.groupBy(*keys).agg(*[
        F.min_by(F.col("value"), F.when(present & (F.col("variable") == v), F.col(tie))).alias(v)
        for v in (variables or HOURLY_VARIABLES)
    ])


def precip_from_components(wide: DataFrame) -> DataFrame:
    """Total precipitation from its parts when the total itself was not delivered."""
    if PRECIP in wide.columns:
        return wide
    parts = [number(F.col(c)) for c in (LARGE_SCALE, CONVECTIVE) if c in wide.columns]
    return wide.withColumn(PRECIP, reduce(Column.__add__, parts)) if parts else wide


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def _with_missing(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("double") for n in names if n not in df.columns})


def _daily_aggregates(precip: Column) -> list[Column]:
    return [
        F.avg(TEMPERATURE).alias("temp_mean"),
        F.max(TEMPERATURE).alias("temp_max"),
        F.coalesce(F.sum(precip), F.lit(0.0)).alias("precip_sum"),
        F.max("wind_speed").alias("wind_max"),
        F.avg(SOIL).alias("soil_moisture_mean"),
    ]


def hourly_to_daily(wide: DataFrame, file_id: str) -> DataFrame:
    """Hourly point rows to one row per point and day.

    Units are tested on the hourly values of each file (or ingest batch).  Wind
    speed is formed per hour before the daily max.  A day without any
    precipitation reading counts as 0 mm.
    """
    frame = _with_missing(wide, HOURLY_VARIABLES).where(F.col("time").isNotNull())
    frame = normalize_units(frame, file_id, [TEMPERATURE], [PRECIP])
    frame = frame.withColumn("wind_speed", wind_speed(number(F.col(WIND_U)), number(F.col(WIND_V))))
    daily = (
        frame.withColumn("date", F.to_date("time"))
        .groupBy("point_id", "lat", "lng", "date").agg(*_daily_aggregates(F.col(PRECIP)))
    )
    return daily.select(
        F.col("date").cast("timestamp").alias("time"), "date",
        F.year("date").alias("year"), F.month("date").alias("month"),
        "point_id", "lat", "lng", *FEATURE_VALUES,
        F.col("temp_mean").alias("temp_mean_c"), F.col("temp_max").alias("temp_max_c"),
        F.col("precip_sum").alias("precip_sum_mm"), F.col("wind_max").alias("wind_max_ms"),
    )


def hourly_to_daily_grid(wide: DataFrame, file_id: str) -> DataFrame:
    """The same on grid cells; here the unit tests look at the *daily* values,
    and the daily mean decides for the daily maximum too."""
    frame = _with_missing(wide, HOURLY_VARIABLES).where(F.col("time").isNotNull())
    frame = frame.withColumns({v: number(F.col(v)) for v in HOURLY_VARIABLES})
    frame = frame.withColumn("wind_speed", wind_speed(F.col(WIND_U), F.col(WIND_V)))
    daily = (
        frame.withColumn("date", F.to_date("time"))
        .groupBy(file_id, "lat", "lng", "date").agg(*_daily_aggregates(F.col(PRECIP)))
    )
    daily = normalize_units(daily, file_id, ["temp_mean", "temp_max"], ["precip_sum"],
                            steer={"temp_max": "temp_mean"})
    return daily.select(
        file_id, F.col("date").cast("timestamp").alias("time"), "date",
        F.year("date").alias("year"), F.month("date").alias("month"), "lat", "lng", *FEATURE_VALUES)


def canonical_features(raw: DataFrame, file_id: str) -> DataFrame:
    """Date, month, canonical units and types; absent columns become NULL."""
    out = _with_missing(raw, FEATURE_VALUES)
    if "date" not in out.columns:
        out = out.withColumn("date", F.to_date("time"))
    out = normalize_units(out, file_id, ["temp_mean", "temp_max"], ["precip_sum"])
    return out.withColumns({
        "wind_max": number(F.col("wind_max")),
        "soil_moisture_mean": number(F.col("soil_moisture_mean")),
        "month": F.month("date"),
    })


def keep_newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order.

    ``row_number() = 1`` is planned with a rank limit below the shuffle, so
    repeated copies of one key collapse before they travel.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def dedupe_newest(features: DataFrame, newest: list[str]) -> DataFrame:
    """One row per (date, cell): the one from the newest file."""
    return keep_newest(features, ["date", *CELL], newest_first(*newest))


def scan_daily_features(raw: DataFrame, start: dt.date | str, end: dt.date | str,
                        file_id: str, newest: list[str]) -> DataFrame:
    """Canonical daily features of a date range, newest file winning.

    Unit rules see whole files, so they come before the date clip.
    """
    clipped = filter_date_range(canonical_features(raw, file_id), start, end)
    return dedupe_newest(clipped, newest).select("date", "month", *CELL, *FEATURE_VALUES)


def distinct_cells(features: DataFrame) -> DataFrame:
    return features.select(*CELL).distinct()


def concat_feature_files(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_grids(cells: DataFrame, file_id: str) -> DataFrame:
    """Per file the fingerprint ``grid`` of its set of cells; files with the same cells share it.

    ``cells``: file_id, lat, lng, distinct.  A fingerprint is the number of cells
    and two 64-bit sums over GF(2) of their hashes: those of parts of a set merge,
    in any order, so files of any size are folded below the shuffle.
    """
    return cells.groupBy(file_id).agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*CELL)).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(1), *CELL)).alias("two")).alias("grid"))


def batch_point_timeseries(assets: DataFrame, raw: DataFrame, start: dt.date | str,
                           end: dt.date | str, file_id: str, newest: list[str]) -> DataFrame:
    """Daily series for many points at once.

    In every file the cell nearest to the (3-decimal) position is taken; per
    date the newest file wins.  ``assets``: asset_id, lat, lng.  Files with the
    same cells have the same answers, so positions are searched once per grid, and
    of a grid's files only the newest row of a cell and date meets a position.
    """
    frame = _with_missing(raw, FEATURE_VALUES)
    if "date" not in frame.columns:
        frame = frame.withColumn("date", F.to_date("time"))
    inside = filter_date_range(frame, start, end)
    grids = file_grids(frame.select(file_id, *CELL).distinct(), file_id).join(
        inside.select(file_id).distinct(), file_id, "left_semi")
    one_file = grids.groupBy("grid").agg(F.min(file_id).alias(file_id))
    cells = frame.select(file_id, *CELL).join(one_file, file_id).select("grid", *CELL).distinct()
    wanted = assets.select(
        "asset_id", F.bround("lat", 3).alias("at_lat"), F.bround("lng", 3).alias("at_lng"))
    # one row per (spot, grid); salted, so that no grid is a hot key
    salted = wanted.select("at_lat", "at_lng").distinct().withColumn("_salt", F.pmod(F.hash("at_lat", "at_lng"), F.lit(SALTS)))
    copies = one_file.select("grid", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    matched = nearest_sites(salted.join(copies, "_salt").drop("_salt"), cells, {"at_lat": "lat", "at_lng": "lng"},
                            group=["grid"])
    dated = keep_newest(inside.join(grids, file_id), ["grid", *CELL, "date"], newest_first(*newest))
    rows = dated.join(matched.drop("distance"), ["grid", *CELL])
    best = keep_newest(rows, ["at_lat", "at_lng", "date"], newest_first(*newest))
    return wanted.join(best.drop(*CELL), ["at_lat", "at_lng"]).select(
        "asset_id", "date", *FEATURE_VALUES, F.lit("era5").alias("source"))


def point_timeseries(spark, lat: float, lng: float, raw: DataFrame, start: dt.date | str,
                     end: dt.date | str, file_id: str, newest: list[str]) -> DataFrame:
    """The same for one position, ordered by date."""
    asset = spark.range(1).select(F.lit("point").alias("asset_id"), F.lit(float(lat)).alias("lat"),
                                  F.lit(float(lng)).alias("lng"))
    series = batch_point_timeseries(asset, raw, start, end, file_id, newest)
    return series.drop("asset_id").orderBy("date")


def climate_series(spark, reanalysis: DataFrame, forecast: DataFrame, start: dt.date | str,
                   end: dt.date | str, today: dt.date | str) -> DataFrame:
    """One row per day: the past from reanalysis, today onwards from forecast
    with reanalysis as fallback; days with neither are left out."""
    values = [*FEATURE_VALUES, "source"]
    past = F.col("date") < day_literal(today)
    joined = (
        day_spine(spark, start, end)
        .join(reanalysis.select("date", F.struct(*values).alias("_r")), "date", "left")
        .join(forecast.select("date", F.struct(*values).alias("_f")), "date", "left")
        .withColumn("_row", F.when(past, F.col("_r")).otherwise(F.coalesce("_f", "_r")))
    )
    return joined.where(F.col("_row").isNotNull()).select("date", "_row.*")


def series_source_label(series: DataFrame) -> DataFrame:
    return series.agg(
        F.when(F.coalesce(F.bool_or(F.col("source") == "era5"), F.lit(False)), F.lit("era5+open-meteo"))
        .otherwise(F.lit("open-meteo")).alias("data_source"))


def points_union(assets: DataFrame, provinces: DataFrame, points_set: str) -> DataFrame:
    """Sampling points of a set name: assets, provinces or both; asset ids are
    unique, later portfolios win."""
    chosen = []
    if "assets" in points_set:
        kept = keep_newest(assets.select("portfolio_id", "asset_id", "lat", "lon").distinct(),
                           ["asset_id"], newest_first("portfolio_id", "lat", "lon"))
        chosen.append(kept.select(F.concat(F.lit("asset:"), F.col("asset_id").cast("string")).alias("point_id"),
                                  "lat", "lon"))
    if "provinces" in points_set:
        plate = F.col("plate").cast("string")
        padded = F.when(F.length(plate) < 2, F.lpad(plate, 2, "0")).otherwise(plate)
        chosen.append(provinces.select(F.concat(F.lit("province:"), padded).alias("point_id"),
                                       "lat", F.col("lng").alias("lon")))
    if not chosen:
        return assets.select(F.lit("").alias("point_id"), "lat", "lon").where(F.lit(False))
    return concat_feature_files(*chosen)


def hourly_point_sample(grid: DataFrame, points: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Grid values at points, nearest per axis, in long form.

    ``grid``: lat, lng, variable, value and either ``time`` or ``init_time`` +
    ``lead_hours``.  Output rows carry the point's own coordinates.  The point
    map is computed once; Spark broadcasts a side if its shuffled size turns out small.
    A node's readings are dealt into ``SHARES`` shares, each of which meets all its
    points: rows come out per reading and point, too many for one task per node.
    ``finish`` changes columns of the readings (time, variable, value) before they meet
    points, such as instants into text: what needs no point is made once per reading.
    """
    if "time" not in grid.columns:
        lead = F.make_dt_interval(F.lit(0), F.col("lead_hours").cast("int"))
        grid = grid.withColumn("time", F.col("init_time") + lead)
    mapped = nearest_axis_sample(points, grid).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    # numbers are made once per reading, not once per reading and point
    readings = grid.where(F.col("time").isNotNull()).select(
        F.col("lat").alias("grid_lat"), F.col("lng").alias("grid_lng"), "time", "variable",
        number(F.col("value")).alias("value"), F.pmod(F.xxhash64("time", "variable", "value"), F.lit(SHARES)).cast("int").alias("_share"))
    if finish:
        readings = finish(readings)
    # by number: partitions small in bytes are not merged, their pairs are many
    keys = ["grid_lat", "grid_lng", "_share"]
    tasks = int(joins_by_measure(grid.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    return readings.repartition(tasks, *keys).join(mapped.repartition(tasks, *keys), keys).select(
        "time", "point_id", F.col("point_lat").alias("lat"), F.col("point_lng").alias("lng"), "variable", "value")


def nearest_axis_sample(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Grid line nearest to each point, for latitude and longitude separately;
    half-way points go to the larger coordinate."""
    lats = nearest_sites(points.select(F.col("lat").alias("point_lat")).distinct(),
                         grid.select("lat").distinct(), {"point_lat": "lat"}, prefer="larger")
    lngs = nearest_sites(points.select(F.col("lon").alias("point_lng")).distinct(),
                         grid.select("lng").distinct(), {"point_lng": "lng"}, prefer="larger")
    return (
        points.select("point_id", F.col("lat").alias("point_lat"), F.col("lon").alias("point_lng"))
        .join(lats.select("point_lat", F.col("lat").alias("grid_lat")), "point_lat")
        .join(lngs.select("point_lng", F.col("lng").alias("grid_lng")), "point_lng")
    )
