"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrahaz.session import shared_folder
from terrahaz.sources.versions import VersionedTable

BASELINE = ("1995-01-01", "1999-12-31")
SCORING = ("2000-01-01", "2001-12-31")
QUARTER = ("2000-01-01", "2000-03-31")
WHOLE = ("1995-01-01", "2001-12-31")
VERSION = "v1"
LEDGER_NOW = "2001-01-01 00:00:00"
FIRE_NOW = "2024-01-14 23:59:59.999999"
FIRE_DAYS = ("2024-01-01", "2024-01-31")


def stored(spark, name: str, rows: DataFrame, *partitions: str) -> VersionedTable:
    """``rows`` as the first version of a table in the shared folder."""
    table = VersionedTable(spark, shared_folder(spark, name), rows.schema, list(partitions))
    table.add(rows)
    return table


def plain(df: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    """Dates and instants as text, named columns rounded."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif places and f.name in places:
            c = F.bround(c, places[f.name])
        columns.append(c.alias(f.name))
    return df.select(*columns)
