"""Unit rules decided from the data of a whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number
from ..functions.quantiles import bound_stats, quantile_above
from ..functions.sizing import broadcast_up_to

# Fixed values of the unit rules.
KELVIN_OFFSET = 273.15
KELVIN_MEDIAN = 150.0
METRE_P99 = 5.0
MM_PER_METRE = 1000.0
# a row of flags per file is broadcast for up to so many files
MOST_FILES = 100_000


def _celsius(value: Column, kelvin: Column) -> Column:
    return F.when(kelvin, value - KELVIN_OFFSET).otherwise(value)


def _millimetres(value: Column, not_metres: Column) -> Column:
    return F.when(~not_metres, value * MM_PER_METRE).otherwise(value)


def normalize_units(df: DataFrame, file_id: str, kelvin_columns: list[str],
                    metre_columns: list[str], steer: dict[str, str] | None = None) -> DataFrame:
    """Coerce to numbers and apply both unit rules, file by file.

    A temperature column whose file-wide median exceeds 150 is Kelvin; a
    precipitation column whose file-wide 99th percentile is at most 5 is metres.
    ``steer`` names another column whose quantile decides (the daily grid build
    converts the maximum whenever the mean looks like Kelvin).  One row of
    counters per file is joined back, so the input is never sorted or collected.

    Runs one job: it measures how many files there are, to broadcast the flags
    instead of shuffling the observations by a handful of file names.  The flags
    are persisted, so that the join does not read the input for them again.
    """
    steer = steer or {}
    coerced = df.withColumns({c: number(F.col(c)) for c in [*kelvin_columns, *metre_columns]})
    measured: list[Column] = []
    flags: list[Column] = []
    for name in kelvin_columns:
        if name not in steer:
            measured += bound_stats(F.col(name), KELVIN_MEDIAN, f"_{name}")
            flags.append(quantile_above(f"_{name}", 0.5, KELVIN_MEDIAN).alias(f"_{name}_flag"))
    for name in metre_columns:
        measured += bound_stats(F.col(name), METRE_P99, f"_{name}")
        flags.append(quantile_above(f"_{name}", 0.99, METRE_P99).alias(f"_{name}_flag"))
    rules = coerced.groupBy(file_id).agg(*measured).select(F.col(file_id).alias("_file"), *flags)
    changed = {}
    for name in kelvin_columns:
        changed[name] = _celsius(F.col(name), F.col(f"_{steer.get(name, name)}_flag"))
    for name in metre_columns:
        changed[name] = _millimetres(F.col(name), F.col(f"_{name}_flag"))
    # a few flags per file, kept for the join; dealing rows by file would read each file in one task
    rules = broadcast_up_to(rules.persist(), MOST_FILES)
    return coerced.join(rules, F.col(file_id).eqNullSafe(F.col("_file"))).withColumns(changed).select(*df.columns)


def unit_temp_to_celsius(df: DataFrame, column: str, file_id: str) -> DataFrame:
    return normalize_units(df, file_id, [column], [])


def unit_precip_to_mm(df: DataFrame, column: str, file_id: str) -> DataFrame:
    return normalize_units(df, file_id, [], [column])
