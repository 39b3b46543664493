"""Scores of assets over a date range."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import CELL, SHARES, distinct_cells
from ..operators.filters import filter_date_range
from ..operators.fires import daily_fire_features
from ..operators.nearest import nearest_cell
from ..operators.perils import entry_rows, peril_windows, weather_rows, weather_scores, wildfire_entry
from ..operators.thresholds import threshold_lookup

# Labels every stored score carries.
SCORE_LABELS = {"scenario": "historical", "horizon": "current", "likelihood": "observed",
                "data_version": "era5_daily_v1"}


def cell_rows(features: DataFrame, monthly: DataFrame, by_doy: DataFrame | None, start: dt.date | str,
              end: dt.date | str, version: str) -> DataFrame:
    """Cell-days of the range with look-back quantities and thresholds.

    Days before the range are not looked at: the first windows are short.
    """
    windowed = peril_windows(filter_date_range(features, start, end))
    return weather_rows(threshold_lookup(windowed, monthly, by_doy, version))


def _for_assets(homes: DataFrame, place: list[str], scored: DataFrame, separator: str | None) -> DataFrame:
    """Scores of a place and day for every asset there.

    A place's days are dealt into ``SHARES`` shares, each of which meets all its
    assets, over a fixed number of tasks: rows come out per day and asset, and
    partitions small in bytes would be merged although their pairs are many.
    """
    if separator is not None:
        scored = scored.withColumn("drivers", F.concat_ws(separator, "drivers"))
    # a whole number as key: joins do not take a deal by doubles for one by their normal form
    spot = F.xxhash64(*[F.col(c) + F.lit(0.0) for c in place]).alias("_spot")
    share = F.pmod(F.xxhash64("date"), F.lit(SHARES)).cast("int").alias("_share")
    keys = ["_spot", "_share"]
    tasks = int(homes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = homes.select("asset_id", *place, spot, F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    dealt = scored.select(*place, "date", "peril", "score", "band", "exposure", "drivers", spot, share)
    return owned.repartition(tasks, *keys).join(dealt.repartition(tasks, *keys), [*keys, *place]).select(
        "asset_id", "date", "peril", "score", "band", "exposure", "drivers")


def batch_scores(features: DataFrame, assets: DataFrame, monthly: DataFrame, by_doy: DataFrame | None,
                 start: dt.date | str, end: dt.date | str, version: str, perils: list[str],
                 fires: DataFrame | None = None, run_id: str = "run", separator: str | None = None) -> DataFrame:
    """One row per asset, day and peril.

    ``assets``: asset_id, lat, lon.  Weather perils are scored once per cell-day
    and then joined to the assets of the cell; wildfire uses the asset's own
    position and is scored once per position and day.  Days without a feature row
    or thresholds yield no row at all.  With a ``separator`` the drivers are one
    text, made before scores are repeated for every asset.
    The distinct cells of the range and the cell of each asset are persisted:
    several joins read them.  An asset id listed twice counts once.
    """
    cells = distinct_cells(filter_date_range(features, start, end)).persist()
    assets = assets.select("asset_id", "lat", "lon").dropDuplicates(["asset_id"])
    places = assets.select(F.struct("asset_id", "lat", "lon").alias("point_id"), "lat", F.col("lon").alias("lng"))
    homes = nearest_cell(places, cells).select(
        "point_id.asset_id", F.col("point_id.lat").alias("at_lat"), F.col("point_id.lon").alias("at_lon"),
        F.col("cell_lat").alias("lat"), F.col("cell_lng").alias("lng")).persist()
    # windows and thresholds only where an asset is at home
    features = features.join(homes.select(*CELL).distinct(), CELL, "left_semi").select(*features.columns)
    rows = cell_rows(features, monthly, by_doy, start, end, version)
    parts = []
    if any(p != "wildfire" for p in perils):
        parts.append(_for_assets(homes, CELL, weather_scores(rows, perils), separator))
    if "wildfire" in perils:
        if fires is None:
            raise ValueError("wildfire scores need the fires table")
        # assets at one position share their cell, their days and their fires
        spots = homes.select("at_lat", "at_lon", *CELL).distinct().join(rows.select(*CELL, "date"), CELL)
        asked = spots.select(F.struct("at_lat", "at_lon").alias("asset_id"), F.col("at_lat").alias("lat"),
                             F.col("at_lon").alias("lon"), "date")
        found = daily_fire_features(asked, fires)
        burnt = entry_rows(found.withColumnsRenamed({"lat": "at_lat", "lon": "at_lon"}), ["at_lat", "at_lon", "date"],
                           {"wildfire": wildfire_entry()})
        parts.append(_for_assets(homes, ["at_lat", "at_lon"], burnt, separator))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    labels = {name: F.lit(value) for name, value in SCORE_LABELS.items()}
    return out.withColumns({**labels, "run_id": F.lit(run_id), "climatology_version": F.lit(version)})

