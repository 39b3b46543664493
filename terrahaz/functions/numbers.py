"""Rounding, bands and defaults.

Rounding is half-to-even everywhere because scores must agree with the
published model on ties: ``rint`` for whole numbers, ``bround`` for decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Perils in reporting order, and the default request.
PERILS = ("heat", "rain", "wind", "drought", "wildfire")
DEFAULT_PERILS = ("heat", "rain", "wind", "drought")

# Lower bound of each severity band.
BANDS = ((80, "Extreme"), (60, "Major"), (40, "Moderate"), (20, "Minor"), (0, "Minimal"))

# Lower bound of each province risk level.
RISK_LEVELS = ((75, "HIGH"), (50, "MEDIUM"))


def as_column(value: Column | str | float | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def whole_score(value: Column) -> Column:
    """0-100 integer; a missing input stays missing instead of becoming 0."""
    return F.when(value.isNotNull(), clamp(F.rint(value), 0.0, 100.0).cast("int"))


def or_default(value: Column, default: Column | float) -> Column:
    """Missing and exactly zero both fall back to the default."""
    fallback = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(F.nullif(value, F.lit(0.0)), fallback)


def band(score: Column) -> Column:
    """Severity band of a score; missing scores have no band."""
    expr = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, name in BANDS[:-1]:
        expr = expr.when(score >= bound, F.lit(name))
    return expr.otherwise(F.lit(BANDS[-1][1]))


def risk_level(score: Column) -> Column:
    expr = F.when(score.isNull(), F.lit(None).cast("string"))
    for bound, name in RISK_LEVELS:
        expr = expr.when(score >= bound, F.lit(name))
    return expr.otherwise(F.lit("LOW"))


def number(value: Column) -> Column:
    """Anything to double; text that is no number, and NaN, become NULL."""
    as_double = value.try_cast("double")
    return F.when(~F.isnan(as_double), as_double)


def fixed_text(value: Column, places: int) -> Column:
    """Fixed-point text, rounded half-to-even before formatting."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", half_even(value, places)))


def normalize_perils(perils: list[str] | None) -> list[str]:
    """Which perils a request means."""
    if not perils:
        return list(DEFAULT_PERILS)
    if "all" in perils:
        return list(PERILS)
    known = [p for p in perils if p in PERILS]
    return known or list(DEFAULT_PERILS)
