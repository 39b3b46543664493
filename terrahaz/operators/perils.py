"""Peril windows and scores.

Heat, rain, wind and drought depend on the cell only, so they are computed once
per cell-day and joined to the assets afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import band, fixed_text, half_even, or_default, whole_score
from .thresholds import cell_frame

MONTH_ROWS, WEEK_ROWS = 30, 7

# Fixed values of the scoring model.
NO_LIMIT = 9999.0
TINY = 1e-6


def peril_windows(features: DataFrame) -> DataFrame:
    """All look-back quantities of a cell-day in a single window pass.

    The day counts compare earlier days with *today's* threshold, which changes
    over the year; the up to 30 readings are therefore kept as a short array
    and counted once the threshold is known.
    """
    month, week = cell_frame(MONTH_ROWS), cell_frame(WEEK_ROWS)
    return features.withColumns({
        "temps_30": F.collect_list("temp_max").over(month),
        "temp_peak": F.max("temp_max").over(month),
        "winds_30": F.collect_list("wind_max").over(month),
        "wind_peak": F.max("wind_max").over(month),
        "rain_7": F.coalesce(F.sum("precip_sum").over(week), F.lit(0.0)),
        "rain_7_peak": F.max("precip_sum").over(week),
        "rain_30": F.coalesce(F.sum("precip_sum").over(month), F.lit(0.0)),
        "soil_30": F.avg("soil_moisture_mean").over(month),
    })


def _days_above(readings: str, limit: Column) -> Column:
    return F.size(F.filter(F.col(readings), lambda reading: reading > limit))


def heat_window(rows: DataFrame) -> DataFrame:
    limit = or_default(F.col("temp_max_p95"), NO_LIMIT)
    return rows.withColumns({
        "hot_days": _days_above("temps_30", limit),
        "max_excess": F.greatest(F.lit(0.0), F.col("temp_peak") - limit),
    })


def rain_window(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"sum7": F.col("rain_7"), "max7": F.col("rain_7_peak")})


def wind_window(rows: DataFrame) -> DataFrame:
    limit = or_default(F.col("wind_max_p95"), NO_LIMIT)
    return rows.withColumns({"windy_days": _days_above("winds_30", limit), "max_wind": F.col("wind_peak")})


def drought_window(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"sum30": F.col("rain_30"), "soil30": F.col("soil_30")})


def score_heat(hot_days: Column, max_excess: Column) -> Column:
    return whole_score((hot_days / 30.0) * 80.0 + F.greatest(F.lit(0.0), max_excess) * 4.0)


def _ratio(value: Column, base: Column) -> Column:
    return value / F.greatest(base, F.lit(TINY))


def score_rain(sum7: Column, max1d: Column, p7_95: Column, p7_99: Column, p1_99: Column) -> Column:
    return whole_score(_ratio(sum7, p7_95) * 45.0 + _ratio(sum7, p7_99) * 25.0 + _ratio(max1d, p1_99) * 30.0)


def score_wind(windy_days: Column, max_wind: Column, p95: Column) -> Column:
    return whole_score((windy_days / 30.0) * 70.0 + _ratio(max_wind, p95) * 30.0)


def dryness(value: Column, base: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - _ratio(value, base))


def score_drought(sum30: Column, p30_10: Column, soil: Column, soil_p10: Column) -> Column:
    return whole_score(dryness(sum30, p30_10) * 55.0 + dryness(soil, soil_p10) * 45.0)


def score_wildfire(nearest_7d: Column, count_24h: Column, count_7d: Column, max_frp_7d: Column) -> Column:
    closeness = F.greatest(F.lit(0.0), (50.0 - F.least(nearest_7d, F.lit(50.0))) / 50.0) * 55.0
    counted = F.least(count_24h * 25.0 + count_7d * 6.0, F.lit(35.0))
    power = F.least((F.coalesce(max_frp_7d, F.lit(0.0)) / 200.0) * 10.0, F.lit(10.0))
    return F.when(nearest_7d.isNull(), F.lit(0)).otherwise(whole_score(closeness + counted + power))


def rain_limits() -> tuple[Column, Column, Column]:
    p7_95 = or_default(F.col("precip_7d_p95"), 1.0)
    return p7_95, or_default(F.col("precip_7d_p99"), p7_95), or_default(F.col("precip_1d_p99"), 1.0)


def drought_limits() -> tuple[Column, Column]:
    return or_default(F.col("precip_30d_p10"), 1.0), or_default(F.col("soil_moisture_p10"), 0.1)


def _entry(peril: str, score: Column, exposure: dict[str, Column], drivers: list[Column]) -> Column:
    pairs = [x for name, value in exposure.items() for x in (F.lit(name), value.cast("double"))]
    return F.struct(
        F.lit(peril).alias("peril"),
        score.alias("score"),
        band(score).alias("band"),
        F.create_map(*pairs).alias("exposure"),
        F.array(*drivers).alias("drivers"),
    )


def heat_entry() -> Column:
    hot, excess = F.col("hot_days"), F.col("max_excess")
    return _entry(
        "heat", score_heat(hot, excess),
        {"hot_days_30d": hot, "max_excess_c": half_even(excess, 2)},
        [F.format_string("%d hot days in last 30d above local p95", hot),
         F.concat(F.lit("max exceedance "), fixed_text(excess, 2), F.lit("C"))])


def rain_entry() -> Column:
    sum7, max7 = F.col("sum7"), F.col("max7")
    p7_95, p7_99, p1_99 = rain_limits()
    return _entry(
        "rain", score_rain(sum7, max7, p7_95, p7_99, p1_99),
        {"precip_7d_mm": half_even(sum7, 2), "max_1d_mm": half_even(max7, 2)},
        [F.concat(F.lit("7d precip "), fixed_text(sum7, 1), F.lit("mm vs local p95 "), fixed_text(p7_95, 1)),
         F.concat(F.lit("max 1d precip "), fixed_text(max7, 1), F.lit("mm vs local p99 "), fixed_text(p1_99, 1))])


def wind_entry() -> Column:
    windy, peak = F.col("windy_days"), F.col("max_wind")
    return _entry(
        "wind", score_wind(windy, peak, or_default(F.col("wind_max_p95"), 1.0)),
        {"windy_days_30d": windy, "max_wind_mps": half_even(peak, 2)},
        [F.format_string("%d windy days in last 30d above local p95", windy),
         F.concat(F.lit("max wind "), fixed_text(peak, 1), F.lit(" m/s"))])


def drought_entry() -> Column:
    sum30, soil = F.col("sum30"), F.col("soil30")
    p30_10, soil_p10 = drought_limits()
    soil_text = F.coalesce(fixed_text(soil, 3), F.lit("nan"))
    return _entry(
        "drought", score_drought(sum30, p30_10, soil, soil_p10),
        {"precip_30d_mm": half_even(sum30, 2), "soil_moisture_anom_ratio": half_even(dryness(soil, soil_p10), 4)},
        [F.concat(F.lit("30d precip "), fixed_text(sum30, 1), F.lit("mm vs dry-tail p10 "), fixed_text(p30_10, 1)),
         F.concat(F.lit("soil moisture ratio to p10: "), soil_text, F.lit("/"), fixed_text(soil_p10, 3))])


def wildfire_entry() -> Column:
    near24, near7 = F.col("nearest_fire_distance_km_24h"), F.col("nearest_fire_distance_km_7d")
    count24, count7 = F.col("fires_within_10km_count_24h"), F.col("fires_within_10km_count_7d")
    frp7 = F.col("max_frp_within_20km_7d")
    return _entry(
        "wildfire", score_wildfire(near7, count24, count7, frp7),
        {"nearest_fire_distance_km_24h": near24, "nearest_fire_distance_km_7d": near7,
         "fires_within_10km_count_24h": count24, "fires_within_10km_count_7d": count7,
         "max_frp_within_20km_7d": frp7},
        [F.format_string("%d active fires within 10km in last 24h", count24),
         F.coalesce(F.concat(F.lit("nearest fire "), fixed_text(near7, 1), F.lit("km away in last 7d")),
                    F.lit("no nearby fires detected in last 7d"))])


def entry_rows(rows: DataFrame, keys: list[str], entries: dict[str, Column]) -> DataFrame:
    """One row per entry.

    Entries are finished as columns first: a generator evaluates a repeated expression
    every time it occurs, in one method too long to be compiled.
    """
    held = rows.select(*keys, *[entry.alias(f"_{peril}") for peril, entry in entries.items()])
    return held.select(*keys, F.inline(F.array(*[f"_{peril}" for peril in entries])))


WEATHER_ENTRIES = {"heat": heat_entry, "rain": rain_entry, "wind": wind_entry, "drought": drought_entry}


def weather_rows(windowed: DataFrame) -> DataFrame:
    """All four windows finished for rows that carry thresholds."""
    return drought_window(wind_window(rain_window(heat_window(windowed))))


def weather_scores(rows: DataFrame, perils: list[str]) -> DataFrame:
    """Long form: one row per cell-day and weather peril; undefined scores drop out."""
    entries = {p: WEATHER_ENTRIES[p]() for p in perils if p in WEATHER_ENTRIES}
    return entry_rows(rows, ["lat", "lng", "date"], entries).where(F.col("score").isNotNull())
