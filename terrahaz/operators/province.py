"""Province flood and drought model from daily rain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_literal, instant_literal
from ..functions.numbers import clamp, half_even, risk_level
from .features import keep_newest

# Fixed values of the province model.
WEEK, SEASON, FULL_HISTORY, MIN_HISTORY = 7, 60, 120, 30
ASSETS_PER_PERSON = 18000
HOTSPOT_RADIUS_KM = 75


def province_dim(raw: DataFrame) -> DataFrame:
    """Province dimension; the insured value follows from the population."""
    return raw.select(
        F.col("plate").cast("string").alias("id"), F.col("plate").cast("int").alias("plate"), "name", "region",
        F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"),
        F.col("population").cast("bigint").alias("population"),
        (F.col("population").cast("bigint") * ASSETS_PER_PERSON).alias("insured_assets"))


def daily_rain_history(rain: DataFrame) -> DataFrame:
    """Missing rain is no rain."""
    return rain.withColumn("rain", F.coalesce(F.col("rain").cast("double"), F.lit(0.0)))


def _history() -> "Window":
    return Window.partitionBy("province_id").orderBy("date")


def province_rolling(rain: DataFrame) -> DataFrame:
    """Rolling sums and baselines at every day, each using only earlier days.

    ``rain``: province_id, date, rain without gaps.  A province's history is one
    row per day, so its window stays small at any number of years.
    """
    past = _history()

    def trailing(rows: int, skip: int = 0) -> Column:
        return F.sum("rain").over(past.rowsBetween(1 - rows - skip, -skip))

    counted = rain.withColumns({
        "n": F.row_number().over(past),
        "r7": trailing(WEEK), "r60": trailing(SEASON), "prev7": trailing(WEEK, WEEK),
    })
    full = counted.withColumns({
        "w7": F.when(F.col("n") >= WEEK, F.col("r7")),
        "w60": F.when(F.col("n") >= SEASON, F.col("r60")),
    })
    mean7 = F.avg("w7").over(past.rowsBetween(Window.unboundedPreceding, -1))
    mean60 = F.avg("w60").over(past.rowsBetween(Window.unboundedPreceding, -2))
    return full.withColumns({
        "base7": F.coalesce(mean7, F.when(F.col("n") >= WEEK, F.col("r7")), F.lit(1.0)),
        "base60": F.when(F.col("n") >= FULL_HISTORY, mean60).otherwise(F.greatest(F.lit(1.0), "r60")),
    }).drop("w7", "w60")


def flood_score(r7: Column, base7: Column) -> Column:
    return F.rint(clamp((r7 / F.greatest(F.lit(1.0), base7) - 0.5) * 80.0, 0.0, 100.0)).cast("int")


def drought_score(r60: Column, base60: Column) -> Column:
    deficit = clamp(1.0 - r60 / F.greatest(F.lit(1.0), base60), 0.0, 1.0)
    return F.rint(clamp(deficit * 120.0, 0.0, 100.0)).cast("int")


def overall_score(flood: Column, drought: Column) -> Column:
    return F.rint(0.65 * flood + 0.35 * drought).cast("int")


def province_trend(rolled: DataFrame) -> DataFrame:
    """Last seven days against the seven before."""
    change = F.when(F.col("prev7") > 0, (F.col("r7") - F.col("prev7")) / F.col("prev7") * 100.0)
    size = half_even(F.abs(change), 1)
    young = F.col("n") < 2 * WEEK
    dry_before = F.col("prev7") <= 0
    return rolled.withColumns({
        "trend": F.when(young, "STABLE").when(dry_before, F.when(F.col("r7") > 0, "UP").otherwise("STABLE"))
        .when(change >= 8, "UP").when(change <= -8, "DOWN").otherwise("STABLE"),
        "trend_pct": F.when(young, F.lit(0.0))
        .when(dry_before, F.when(F.col("r7") > 0, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(size),
    })


def score_provinces(rain: DataFrame) -> DataFrame:
    """Scores for every day of every province with at least 30 days in all."""
    days = F.count(F.lit(1)).over(Window.partitionBy("province_id"))
    enough = rain.withColumn("_days", days).where(F.col("_days") >= MIN_HISTORY).drop("_days")
    rolled = province_trend(province_rolling(enough))
    scored = rolled.withColumns({
        "flood_score": flood_score(F.col("r7"), F.col("base7")),
        "drought_score": drought_score(F.col("r60"), F.col("base60")),
    }).withColumn("overall_score", overall_score(F.col("flood_score"), F.col("drought_score")))
    return scored.select(
        "province_id", F.col("date").alias("as_of_date"), "flood_score", "drought_score", "overall_score",
        risk_level(F.col("overall_score")).alias("risk_level"), "trend", "trend_pct",
        half_even(F.col("r7"), 1).alias("rain_7d_mm"), half_even(F.col("r60"), 1).alias("rain_60d_mm"))


def province_asof_scores(rain: DataFrame, today: dt.date | str, days: int) -> DataFrame:
    """Scores of the last ``days`` days up to today."""
    scored = score_provinces(rain.where(F.col("date") <= day_literal(today)))
    return scored.where(F.col("as_of_date") > F.date_sub(day_literal(today), days))


def province_alerts(provinces: DataFrame, scores: DataFrame, hits: DataFrame, as_of: dt.date | str,
                    now: dt.datetime | str, radius_km: int = HOTSPOT_RADIUS_KM) -> DataFrame:
    """Up to three alerts per province.  ``hits``: id, hits (fires near the province)."""
    day = scores.where(F.col("as_of_date") == day_literal(as_of))
    rows = (
        day.join(provinces.select(F.col("id").alias("province_id"), "name"), "province_id")
        .join(hits.select(F.col("id").alias("province_id"), "hits"), "province_id", "left")
    )
    flood, drought, fires = F.col("flood_score"), F.col("drought_score"), F.col("hits")

    def alert(kind: str, level: Column, policies: Column, loss: Column, message: Column) -> Column:
        return F.struct(
            F.concat_ws("-", F.lit(kind.lower()), "province_id", F.lit(str(as_of))).alias("id"),
            "province_id", level.alias("level"), F.lit(kind).alias("risk_type"),
            policies.cast("bigint").alias("affected_policies"), loss.cast("bigint").alias("estimated_loss_usd"),
            message.alias("message"), instant_literal(now).alias("issued_at"), F.lit(True).alias("active"))

    rain_text = F.format_string("%.1f", "rain_7d_mm")
    kinds = [
        F.when(flood >= 85, alert(
            "FLOOD", F.lit("HIGH"), 1200 + flood * 10, 750000 + flood * 17500,
            F.concat(F.lit("Heavy rainfall anomaly for "), "name", F.lit(". 7-day rainfall: "), rain_text,
                     F.lit(" mm.")))),
        F.when(drought >= 60, alert(
            "DROUGHT", F.when(drought >= 75, "HIGH").otherwise("MEDIUM"), 900 + drought * 9,
            500000 + drought * 12000,
            F.concat(F.lit("60-day rainfall deficit elevated in "), "name", F.lit(". Drought score: "),
                     drought.cast("string"), F.lit(".")))),
        F.when(fires > 0, alert(
            "WILDFIRE", F.when(fires >= 10, "HIGH").otherwise("MEDIUM"), 700 + fires * 35, 350000 + fires * 60000,
            F.concat(F.lit("NASA FIRMS detected "), fires.cast("string"),
                     F.lit(f" recent hotspot(s) within {radius_km} km of "), "name", F.lit(".")))),
    ]
    return rows.select(F.inline(F.array_compact(F.array(*kinds))))


def latest_province_scores(provinces: DataFrame, scores: DataFrame, region: str | None = None,
                           min_score: int | None = None, level: str | None = None,
                           limit: int | None = None) -> DataFrame:
    """Each province's newest score, then the filters, worst first."""
    newest = keep_newest(scores, ["province_id"], [F.col("as_of_date").desc()])
    rows = provinces.withColumnRenamed("id", "province_id").join(newest, "province_id")
    if region is not None:
        rows = rows.where(F.col("region") == region)
    if level is not None:
        rows = rows.where(F.col("risk_level") == level)
    if min_score is not None:
        rows = rows.where(F.col("overall_score") >= min_score)
    rows = rows.orderBy(F.col("overall_score").desc(), "province_id")
    return rows if limit is None else rows.limit(limit)


def latest_province_one(provinces: DataFrame, scores: DataFrame, province_id: str) -> DataFrame:
    mine = scores.where(F.col("province_id") == province_id)
    return latest_province_scores(provinces.where(F.col("id") == province_id), mine)


def latest_as_of_date(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max("as_of_date").alias("as_of_date"))


def top_k_provinces(latest: DataFrame, k: int = 5) -> DataFrame:
    return latest.orderBy(F.col("overall_score").desc(), "province_id").limit(k)


def alert_order(alerts: DataFrame, limit: int) -> DataFrame:
    """HIGH first, then by loss and time, newest first."""
    return alerts.orderBy(
        F.when(F.col("level") == "HIGH", 0).otherwise(1), F.col("estimated_loss_usd").desc(),
        F.col("issued_at").desc(), "id").limit(limit)


def active_alerts(alerts: DataFrame, provinces: DataFrame, level: str | None = None,
                  limit: int | None = None) -> DataFrame:
    rows = alerts.where("active")
    if level is not None:
        rows = rows.where(F.col("level") == level)
    rows = rows.join(provinces.select(F.col("id").alias("province_id"), F.col("name").alias("province_name")),
                     "province_id")
    return rows if limit is None else alert_order(rows, limit)


def alerts_source_label(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.when(F.bool_or(F.col("risk_type") == "WILDFIRE"), "open-meteo+firms")
        .when(F.count(F.lit(1)) > 0, "open-meteo").alias("data_source"))


def dashboard_stats(latest: DataFrame, alerts: DataFrame) -> DataFrame:
    """Province counts by level, and the policies and loss of all alerts (one row)."""
    def level_count(name: str) -> Column:
        return F.sum(F.when(F.col("risk_level") == name, 1).otherwise(0)).cast("bigint").alias(name.lower())

    facts = latest.select("risk_level", F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("l"))
    facts = facts.unionByName(alerts.select(
        F.lit(None).cast("string").alias("risk_level"), F.col("affected_policies").cast("bigint").alias("p"),
        F.col("estimated_loss_usd").cast("bigint").alias("l")))
    return facts.agg(level_count("HIGH"), level_count("MEDIUM"), level_count("LOW"),
                     F.sum("p").alias("total_policies"), F.sum("l").alias("total_loss_usd"))


def alert_level_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(*[
        F.count(F.when(F.col("level") == name, 1)).alias(f"{name.lower()}_count") for name in ("HIGH", "MEDIUM")])


# Fixed values of the insured-loss estimate.
FLOOD_FACTOR, DROUGHT_FACTOR, PREMIUM_LOADING = 0.0015, 0.0008, 1.40


def insured_loss(requests: DataFrame, latest: DataFrame) -> DataFrame:
    """Expected loss and premium.  ``requests``: province_id, policy_count, sum_insured."""
    insured = F.col("sum_insured")
    flood = insured * F.col("flood_score") * FLOOD_FACTOR
    drought = insured * F.col("drought_score") * DROUGHT_FACTOR
    total = flood + drought
    rows = requests.join(latest, "province_id")
    return rows.select(
        "province_id", "risk_level", "policy_count", "sum_insured", "flood_score", "drought_score",
        half_even(flood, 2).alias("flood_loss"), half_even(flood / insured, 4).alias("flood_loss_ratio"),
        half_even(drought, 2).alias("drought_loss"), half_even(drought / insured, 4).alias("drought_loss_ratio"),
        half_even(total, 2).alias("total_loss"), half_even(total / insured, 4).alias("combined_loss_ratio"),
        half_even(total * PREMIUM_LOADING, 2).alias("suggested_premium"),
        advice().alias("recommendations"))


# The advice texts.
ADVICE = {
    "flood_high": ("Enforce mandatory flood cover for all policies in this province.",
                   "Require elevation certificates for properties below 5 m AMSL."),
    "flood_medium": ("Apply a flood sub-limit of 50 % of sum insured for coastal assets.",),
    "drought_high": ("Implement agricultural drought riders for farm-related policies.",
                     "Consider reinsurance treaty for drought aggregate exposure."),
    "drought_medium": ("Monitor soil-moisture indices quarterly for early drought warning.",),
    "level_high": ("Restrict new policy issuance in HIGH-risk zones pending re-underwriting.",
                   "Increase deductible floors by 25 % for residential properties."),
    "level_medium": ("Schedule annual portfolio review for this province.",),
    "rising": ("Risk trend is increasing — consider rate adjustment at next renewal.",),
    "none": ("No immediate action required. Continue standard monitoring.",),
}


def advice() -> Column:
    """Recommendation texts from the scores, level and trend of a row."""
    def texts(name: str) -> Column:
        return F.array(*[F.lit(t) for t in ADVICE[name]])

    nothing = F.array().cast("array<string>")

    def by_score(score: Column, peril: str) -> Column:
        return F.when(score >= 75, texts(f"{peril}_high")).when(score >= 50, texts(f"{peril}_medium")).otherwise(nothing)

    chosen = F.concat(
        by_score(F.col("flood_score"), "flood"), by_score(F.col("drought_score"), "drought"),
        F.when(F.col("risk_level") == "HIGH", texts("level_high"))
        .when(F.col("risk_level") == "MEDIUM", texts("level_medium")).otherwise(nothing),
        F.when(F.col("trend") == "UP", texts("rising")).otherwise(nothing))
    return F.when(F.size(chosen) == 0, texts("none")).otherwise(chosen)


def recommendations(rows: DataFrame) -> DataFrame:
    return rows.withColumn("recommendations", advice())


def map_name_join(regions: DataFrame, risks: DataFrame) -> DataFrame:
    """Region names to risk rows.

    A risk row answers to its local name, its English name and the lower-case
    form of either; the last row claiming a name wins.  A region tries its exact
    name, then its lower-case name; without a match the risk is 0.
    """
    claims = F.array(*[
        F.struct(F.lit(rank).alias("rank"), name.alias("claimed"))
        for rank, name in enumerate((F.col("name"), F.col("name_en"), F.lower("name"), F.lower("name_en")))])
    claimed = risks.select("seq", "name_en", "risk", F.inline(claims))
    lookup = keep_newest(claimed, ["claimed"], [F.col("seq").desc(), F.col("rank").desc()]).select(
        "claimed", F.struct("risk", "name_en").alias("hit"))
    exact = regions.join(lookup.withColumnRenamed("hit", "h1"), F.col("region_name") == F.col("claimed"), "left").drop("claimed")
    both = exact.join(lookup.withColumnRenamed("hit", "h2"), F.lower("region_name") == F.col("claimed"), "left")
    hit = F.coalesce("h1", "h2")
    return both.select(
        "region_name", F.coalesce(hit.getField("risk"), F.lit(0)).alias("risk_score"),
        F.coalesce(hit.getField("name_en"), F.col("region_name")).alias("province_name"))
