"""Deciding about broadcasts by measuring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if it really holds at most ``rows`` rows.

    Runs one job that stops after ``rows + 1`` rows.  A larger side is returned
    unmarked and joins by shuffle, where adaptive execution splits hot keys.
    """
    measured = df.limit(rows + 1).count()
    return F.broadcast(df) if measured <= rows else df
