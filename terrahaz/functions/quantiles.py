"""Testing a quantile against a bound without collecting the values.

The unit rules ask only whether an interpolated quantile lies above a fixed
bound.  That needs four mergeable scalars per group -- the row count, the count
at or below the bound, and the two values next to the bound -- so a group of
any size aggregates map-side in constant memory, and the answer is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound_stats(value: Column, bound: float, prefix: str) -> list[Column]:
    return [
        F.count(value).alias(f"{prefix}_n"),
        F.count(F.when(value <= bound, 1)).alias(f"{prefix}_below"),
        F.max(F.when(value <= bound, value)).alias(f"{prefix}_last_below"),
        F.min(F.when(value > bound, value)).alias(f"{prefix}_first_above"),
    ]


def quantile_above(prefix: str, q: float, bound: float) -> Column:
    """Is the linearly interpolated ``q`` quantile greater than ``bound``?"""
    n, below = F.col(f"{prefix}_n"), F.col(f"{prefix}_below")
    low, high = F.col(f"{prefix}_last_below"), F.col(f"{prefix}_first_above")
    position = (n - 1) * F.lit(q)
    rank = F.floor(position)
    fraction = position - rank
    straddling = F.when((fraction > 0) & high.isNotNull(), low + (high - low) * fraction).otherwise(low)
    return (
        F.when(n == 0, F.lit(None).cast("boolean"))
        .when(rank >= below, F.lit(True))
        .when(rank + 1 < below, F.lit(False))
        .otherwise(straddling > bound)
    )
