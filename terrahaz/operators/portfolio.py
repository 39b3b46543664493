"""Portfolio roll-ups of stored scores.

``scores``: asset_id, date, peril, score, band (and drivers where noted).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import BANDS, PERILS, band, half_even
from .features import keep_newest
from .filters import filter_date_range


def portfolio_scores(scores: DataFrame, assets: DataFrame, portfolio_id: str,
                     start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Scores of a portfolio's assets in a date range, whatever their version."""
    owned = assets.where(F.col("portfolio_id") == portfolio_id).select("asset_id").distinct()
    return filter_date_range(scores, start, end).join(owned, "asset_id", "left_semi")


def all_hazards_daily(scores: DataFrame) -> DataFrame:
    """Mean over perils per asset and day; the band is that of the rounded mean."""
    daily = scores.groupBy("asset_id", "date").agg(F.avg("score").alias("score"))
    return daily.withColumn("band", band(F.rint("score")))


def band_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("peril", "band").agg(F.count(F.lit(1)).alias("n"))


def band_counts(all_hazards: DataFrame) -> DataFrame:
    """Asset-days per band, all five bands present."""
    counts = all_hazards.agg(*[
        F.count(F.when(F.col("band") == name, 1)).alias(name.lower()) for _, name in BANDS])
    entries = [F.struct(F.lit(name.lower()).alias("band"), F.col(name.lower()).alias("n")) for _, name in BANDS]
    return counts.select(F.inline(F.array(*entries)))


def band_percent(counts: DataFrame) -> DataFrame:
    """Share of each band in percent, one decimal, halves up.  Five rows only."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    share = F.when(total > 0, F.floor(F.col("n") / total * 1000 + 0.5) / 10).otherwise(0.0)
    return counts.select("band", "n", share.alias("pct"))


def _with_all(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Append, per key, an "all" row: the mean of the rounded peril means.

    Averaged in whole hundredths, so the order of the perils cannot matter.
    """
    mean = (F.rint(F.avg(F.rint(F.col(name) * 100))) / 100).alias(name)
    overall = df.groupBy(*keys).agg(mean) if keys else df.agg(mean).where(F.col(name).isNotNull())
    return df.unionByName(overall.withColumn("peril", F.lit("all")))


def peril_averages(scores: DataFrame) -> DataFrame:
    means = scores.groupBy("peril").agg(half_even(F.avg("score"), 2).alias("avg_score"))
    return _with_all(means, [], "avg_score")


def trend_by_date(scores: DataFrame) -> DataFrame:
    means = scores.groupBy("date", "peril").agg(half_even(F.avg("score"), 2).alias("avg_score"))
    return _with_all(means, ["date"], "avg_score")


def trend_direction(all_hazards: DataFrame) -> DataFrame:
    """First against last daily mean."""
    daily = all_hazards.groupBy("date").agg(F.avg("score").alias("score"))
    ends = daily.agg(F.min_by("score", "date").alias("first"), F.max_by("score", "date").alias("last"),
                     F.count(F.lit(1)).alias("n"))
    moved = F.col("last") - F.col("first")
    return ends.select(
        F.when((F.col("n") >= 2) & (moved > 2), "up").when((F.col("n") >= 2) & (moved < -2), "down")
        .otherwise("stable").alias("direction"),
        half_even(F.col("first"), 2).alias("start_score"), half_even(F.col("last"), 2).alias("end_score"))


def top_k_assets(all_hazards: DataFrame, k: int = 10) -> DataFrame:
    means = all_hazards.groupBy("asset_id").agg(F.avg("score").alias("avg_score"))
    return means.orderBy(F.col("avg_score").desc(), "asset_id").limit(k)


def top_assets(scores: DataFrame, assets: DataFrame, k: int = 10) -> DataFrame:
    """The k worst assets with position, band and mean per peril (0.0 if unscored).

    The k winners are found first; only their rows are pivoted.
    """
    best = top_k_assets(all_hazards_daily(scores), k)
    few = F.broadcast(best)  # k rows
    means = scores.join(few.select("asset_id"), "asset_id", "left_semi").groupBy("asset_id").agg(*[
        F.coalesce(half_even(F.avg(F.when(F.col("peril") == p, F.col("score"))), 2), F.lit(0.0)).alias(f"score_{p}")
        for p in PERILS])
    places = assets.select("asset_id", "lat", "lon").join(few.select("asset_id"), "asset_id", "left_semi").groupBy(
        "asset_id").agg(F.min(F.struct("lat", "lon")).alias("_at"))
    return (
        best.join(means, "asset_id").join(places, "asset_id", "left")
        .select("asset_id", F.col("asset_id").alias("name"), F.col("_at.lat").alias("lat"),
                F.col("_at.lon").alias("lon"), F.lower(band(F.rint("avg_score"))).alias("band"),
                *[f"score_{p}" for p in PERILS], half_even(F.col("avg_score"), 2).alias("score_all"))
    )


def batch_series_long(scores: DataFrame, perils: list[str]) -> DataFrame:
    """(asset, date, peril) rows plus the "all" rows over the requested perils.

    The overall band comes from the two-decimal mean itself, not from a whole
    number."""
    rows = scores.select("asset_id", "date", "peril", F.col("score").cast("double").alias("score"),
                         F.lower("band").alias("band"))
    mean = half_even(F.avg("score"), 2)
    overall = rows.where(F.col("peril").isin(perils)).groupBy("asset_id", "date").agg(mean.alias("score"))
    return rows.unionByName(overall.select(
        "asset_id", "date", F.lit("all").alias("peril"), "score", F.lower(band(F.col("score"))).alias("band")))


def batch_series(scores: DataFrame, perils: list[str]) -> DataFrame:
    """One row per asset and date with maps peril -> score, band, drivers."""
    def as_map(value: str) -> Column:
        return F.map_from_entries(F.collect_list(F.struct("peril", value)))

    long = scores.select("asset_id", "date", "peril", F.col("score").cast("double").alias("score"),
                         F.lower("band").alias("band"), "drivers")
    points = long.groupBy("asset_id", "date").agg(
        as_map("score").alias("scores"), as_map("band").alias("bands"), as_map("drivers").alias("drivers"),
        half_even(F.avg(F.when(F.col("peril").isin(perils), F.col("score"))), 2).alias("_all"))
    with_all = F.col("_all").isNotNull()
    return points.select(
        "asset_id", "date",
        F.when(with_all, F.map_concat("scores", F.create_map(F.lit("all"), F.col("_all"))))
        .otherwise(F.col("scores")).alias("scores"),
        F.when(with_all, F.map_concat("bands", F.create_map(F.lit("all"), F.lower(band(F.col("_all"))))))
        .otherwise(F.col("bands")).alias("bands"),
        "drivers")


def latest_series_point(series: DataFrame) -> DataFrame:
    """Newest point of every asset."""
    return keep_newest(series, ["asset_id"], [F.col("date").desc()])


def export_asset_max(scores: DataFrame, assets: DataFrame, include_drivers: bool = True) -> DataFrame:
    """One export row per scored asset: the maximum per peril and the first
    driver of the earliest day that reached it.

    Scores are whole numbers.  Score and day make one number, whose maximum is kept
    in place; a maximum of texts would sort all rows.  The rows stream past the
    maxima to find their drivers.
    """
    rank = F.coalesce(F.col("score").cast("long"), F.lit(-(1 << 30))) * (1 << 32) - F.coalesce(F.unix_date("date"), F.lit((1 << 31) - 1))
    rows = scores.select("asset_id", "peril", "score", F.get("drivers", F.lit(0)).alias("driver"), rank.alias("_rank"))
    top = rows.groupBy("asset_id", "peril").agg(F.max("_rank").alias("_rank")).withColumnsRenamed({"peril": "_peril"})
    best = rows.join(top.hint("shuffle_hash"), ["asset_id", "_rank"]).where(F.col("peril").eqNullSafe(F.col("_peril"))).withColumn(
        "best", F.struct("score", "driver"))
    columns = {"heat": "score_heat", "rain": "score_precip", "wind": "score_wind",
               "drought": "score_drought", "wildfire": "score_wildfire"}
    picked = {p: F.max(F.when(F.col("peril") == p, F.col("best"))) for p in PERILS}
    wide = best.groupBy("asset_id").agg(*[c.alias(p) for p, c in picked.items()])
    texts = [F.concat(F.lit(f"{p}:"), F.col(f"{p}.driver")) for p in PERILS]
    drivers = F.concat_ws(" | ", *texts) if include_drivers else F.lit("")
    return assets.select("asset_id", "lat", "lon").join(wide, "asset_id").select(
        "asset_id", "lat", "lon",
        *[F.coalesce(F.col(f"{p}.score"), F.lit(0)).cast("int").alias(name) for p, name in columns.items()],
        drivers.alias("top_drivers"))


def list_portfolios(assets: DataFrame) -> DataFrame:
    ids = assets.select("portfolio_id").distinct().orderBy("portfolio_id")
    return ids.select("portfolio_id", F.col("portfolio_id").alias("name"))


def risk_summary(spark: SparkSession, scores: DataFrame, assets: DataFrame, portfolio_id: str,
                 start: dt.date | str, end: dt.date | str) -> dict[str, DataFrame]:
    """All parts of a portfolio summary; without scores every part but the zero
    band counts is empty.

    The portfolio's scores feed seven aggregates, so they are persisted (lineage
    stays: a lost executor only costs a recompute).  Call ``unpersist`` on
    ``parts["scores"]`` when done.
    """
    chosen = portfolio_scores(scores, assets, portfolio_id, start, end).persist()
    owned = assets.where(F.col("portfolio_id") == portfolio_id)
    hazards = all_hazards_daily(chosen)
    counts = band_counts(hazards)
    return {
        "scores": chosen,
        "distribution": band_distribution(chosen),
        "bands": counts,
        "band_percent": band_percent(counts),
        "peril_averages": peril_averages(chosen),
        "trend": trend_by_date(chosen),
        "trend_summary": trend_direction(hazards).where(F.col("start_score").isNotNull()),
        "top_assets": top_assets(chosen, owned),
    }


def risk_summary_long(scores: DataFrame, assets: DataFrame, portfolio_id: str,
                      start: dt.date | str, end: dt.date | str) -> DataFrame:
    """The numeric parts of the summary as (part, key, value) rows."""
    chosen = portfolio_scores(scores, assets, portfolio_id, start, end)
    hazards = all_hazards_daily(chosen)
    parts = [
        band_counts(hazards).select(F.lit("bands").alias("part"), F.col("band").alias("key"),
                                    F.col("n").cast("double").alias("value")),
        peril_averages(chosen).select(F.lit("peril_averages").alias("part"), F.col("peril").alias("key"),
                                      F.col("avg_score").alias("value")),
        trend_by_date(chosen).select(
            F.lit("trend").alias("part"),
            F.concat_ws("/", F.col("date").cast("string"), "peril").alias("key"), F.col("avg_score").alias("value")),
        top_k_assets(hazards).select(F.lit("top_assets").alias("part"), F.col("asset_id").alias("key"),
                                     half_even(F.col("avg_score"), 2).alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
