import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrahaz.functions.numbers import normalize_perils
from terrahaz.operators import perils as pe
from terrahaz.operators import portfolio as pf
from terrahaz.operators import thresholds as th
from terrahaz.plans.scoring import batch_scores

MONTHLY = ("climatology_version string, cell_lat double, cell_lng double, month int, temp_max_p95 double, wind_max_p95 double, "
           "precip_1d_p95 double, precip_1d_p99 double, precip_7d_p95 double, precip_7d_p99 double, precip_30d_p10 double, soil_moisture_p10 double")
DAYS = "date date, lat double, lng double, temp_mean double, temp_max double, precip_sum double, wind_max double, soil_moisture_mean double"


def scalar(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*values):
    return [F.lit(v) for v in values]


def test_scores_grow_with_severity(spark):
    pairs = [
        (pe.score_heat(*lit(1, 0.5)), pe.score_heat(*lit(20, 6.0))),
        (pe.score_rain(*lit(5.0, 2.0, 40.0, 60.0, 25.0)), pe.score_rain(*lit(70.0, 45.0, 40.0, 60.0, 25.0))),
        (pe.score_wind(*lit(1, 8.0, 14.0)), pe.score_wind(*lit(15, 22.0, 14.0))),
        (pe.score_drought(*lit(30.0, 20.0, 0.3, 0.2)), pe.score_drought(*lit(2.0, 20.0, 0.05, 0.2))),
        (pe.score_wildfire(*lit(45.0, 0, 0, 1.0)), pe.score_wildfire(*lit(2.0, 2, 3, 150.0))),
    ]
    for mild, severe in pairs:
        assert scalar(spark, mild) < scalar(spark, severe)


def test_exact_values(spark):
    assert scalar(spark, pe.score_heat(*lit(15, 2.5))) == 50
    assert scalar(spark, pe.score_wildfire(*lit(0.0, 1, 1, 400.0))) == 96
    assert scalar(spark, pe.score_wildfire(F.lit(None).cast("double"), F.lit(0), F.lit(0), F.lit(None).cast("double"))) == 0
    assert scalar(spark, pe.score_rain(F.lit(None).cast("double"), *lit(1.0, 1.0, 1.0, 1.0))) is None


def monthly(spark, *cells, version="v"):
    return spark.createDataFrame([(version, la, ln, m, *vals) for la, ln, m, vals in cells], MONTHLY)


EIGHT = (30.0, 10.0, 20.0, 40.0, 50.0, 80.0, 15.0, 0.15)


def test_threshold_fallbacks(spark):
    month = monthly(spark, (41.0, 29.0, 1, EIGHT), (38.0, 27.0, 2, EIGHT), version="vtest")
    doy = month.withColumn("doy", F.lit(5)).drop("month").withColumn("temp_max_p95", F.lit(11.0)).where("cell_lat = 41.0")
    days = spark.createDataFrame(
        [(dt.date(2024, 1, 5), 41.02, 28.98), (dt.date(2024, 1, 5), 41.0, 29.0), (dt.date(2024, 1, 6), 41.0, 29.0),
         (dt.date(2024, 3, 1), 41.0, 29.0)], "date date, lat double, lng double")
    got = {(r["date"].day, r["lat"]): r["temp_max_p95"] for r in th.threshold_lookup(days, month, doy, "vtest").collect()}
    assert got == {(5, 41.02): 30.0, (5, 41.0): 11.0, (6, 41.0): 30.0}
    assert th.threshold_lookup(days, month, doy, "other").count() == 0


def test_leap_day_has_its_own_day_of_year(spark):
    frame = spark.createDataFrame([(dt.date(2020, 12, 31), 1.0, 1.0, 1.0, 9.0, 1.0, 1.0, 0.1)], DAYS)
    assert th.build_climatology(frame, "2020-01-01", "2020-12-31", "v", "doy").first()["doy"] == 366


def test_climatology_without_readings_is_missing(spark):
    frame = spark.createDataFrame([(dt.date(2020, 1, d), 1.0, 1.0, None, None, None, None, None) for d in (1, 2)], DAYS)
    got = th.build_climatology(frame, "2020-01-01", "2020-12-31", "v").first()
    assert got["precip_7d_p95"] is None and got["temp_max_p95"] is None


def scored(spark, values, eight=EIGHT):
    start = dt.date(2024, 1, 1)
    frame = spark.createDataFrame([(start + dt.timedelta(i), 41.0, 29.0, *v) for i, v in enumerate(values)], DAYS)
    assets = spark.createDataFrame([("a", 41.3, 29.2)], "asset_id string, lat double, lon double")
    month = monthly(spark, (41.0, 29.0, 1, eight), (41.0, 29.0, 2, eight))
    out = batch_scores(frame, assets, month, None, "2024-01-01", "2024-02-29", "v", ["heat", "rain", "wind", "drought"])
    return {(r["date"], r["peril"]): r for r in out.collect()}


def test_windows_count_rows_not_days_and_compare_with_todays_threshold(spark):
    got = scored(spark, [(1.0, 31.0, 5.0, 12.0, 0.2)] * 35)
    first, last = got[(dt.date(2024, 1, 1), "heat")], got[(dt.date(2024, 2, 4), "heat")]
    assert first["exposure"]["hot_days_30d"] == 1 and last["exposure"]["hot_days_30d"] == 30
    assert last["score"] == 84 and last["band"] == "Extreme"
    assert last["drivers"] == ["30 hot days in last 30d above local p95", "max exceedance 1.00C"]
    assert got[(dt.date(2024, 2, 4), "rain")]["exposure"] == {"precip_7d_mm": 35.0, "max_1d_mm": 5.0}
    assert (first["scenario"], first["likelihood"], first["data_version"]) == ("historical", "observed", "era5_daily_v1")


def test_zero_thresholds_count_as_absent(spark):
    got = scored(spark, [(1.0, 31.0, 5.0, 12.0, 0.2)], (0.0,) * 8)
    day = dt.date(2024, 1, 1)
    assert got[(day, "heat")]["score"] == 0
    assert got[(day, "wind")]["exposure"]["windy_days_30d"] == 0
    assert got[(day, "rain")]["drivers"][0] == "7d precip 5.0mm vs local p95 1.0"
    assert got[(day, "drought")]["drivers"][1] == "soil moisture ratio to p10: 0.200/0.100"


def test_windows_without_readings(spark):
    got = scored(spark, [(None,) * 5])
    perils = {p for _, p in got}
    assert perils == {"heat", "drought"}
    assert got[(dt.date(2024, 1, 1), "heat")]["score"] == 0


def test_scores_of_one_place_are_repeated_in_several_tasks(spark):
    """Small in bytes, a cell's days once were merged into few tasks that made all rows; fires went by asset and day."""
    start = dt.date(2024, 1, 1)
    frame = spark.createDataFrame([(start + dt.timedelta(i), 41.0, 29.0, 1.0, 31.0, 5.0, 12.0, 0.2) for i in range(10)], DAYS)
    assets = spark.range(60).select(F.concat(F.lit("a"), F.col("id") % 50).alias("asset_id"), F.lit(41.3).alias("lat"), F.lit(29.2).alias("lon"))
    fires = spark.createDataFrame([(dt.datetime(2024, 1, 4, 12), 41.3, 29.2, 50.0)], "time_utc timestamp, lat double, lon double, frp double")
    out = batch_scores(frame, assets, monthly(spark, (41.0, 29.0, 1, EIGHT)), None, "2024-01-01", "2024-01-31", "v",
                       ["heat", "wildfire"], fires, separator="; ").withColumn("task", F.spark_partition_id())
    got = out.collect()
    assert len(got) == len({(r["asset_id"], r["date"], r["peril"]) for r in got}) == 50 * 10 * 2
    assert len({r["task"] for r in got if r["peril"] == "heat"}) > 1
    texts = {(r["date"].day, r["drivers"]) for r in got if r["peril"] == "wildfire"}
    assert (3, "0 active fires within 10km in last 24h; no nearby fires detected in last 7d") in texts
    assert (4, "1 active fires within 10km in last 24h; nearest fire 0.0km away in last 7d") in texts and len(texts) == 10


@pytest.mark.parametrize("asked,want", [
    (None, ["heat", "rain", "wind", "drought"]), ([], ["heat", "rain", "wind", "drought"]),
    (["all"], ["heat", "rain", "wind", "drought", "wildfire"]), (["wildfire", "hail"], ["wildfire"]),
    (["hail"], ["heat", "rain", "wind", "drought"])])
def test_normalize_perils(asked, want):
    assert normalize_perils(asked) == want


SEED = [(a, dt.date(2024, 1, 1), p, s, b) for a, s, b in (("a1", 80, "Extreme"), ("a2", 50, "Moderate"), ("a3", 20, "Minor"))
        for p in ("heat", "rain", "wind", "drought")]


def test_summary_of_seed_scores(spark):
    scores = spark.createDataFrame(SEED, "asset_id string, date date, peril string, score int, band string")
    assets = spark.createDataFrame([("demo", "a1", 41.01, 28.97), ("demo", "a2", 39.93, 32.85), ("demo", "a3", 38.42, 27.14)],
                                   "portfolio_id string, asset_id string, lat double, lon double")
    parts = pf.risk_summary(spark, scores, assets, "demo", "2024-01-01", "2024-01-31")
    assert {r["band"]: r["n"] for r in parts["bands"].collect()} == {"extreme": 1, "major": 0, "moderate": 1, "minor": 1, "minimal": 0}
    assert {r["peril"]: r["avg_score"] for r in parts["peril_averages"].collect()} == dict.fromkeys(["heat", "rain", "wind", "drought", "all"], 50.0)
    top = parts["top_assets"].orderBy(F.col("score_all").desc()).collect()
    assert [(r["asset_id"], r["band"], r["score_wildfire"]) for r in top] == [("a1", "extreme", 0.0), ("a2", "moderate", 0.0), ("a3", "minor", 0.0)]
    assert parts["trend_summary"].first()["direction"] == "stable"
    none = pf.risk_summary(spark, scores, assets, "nobody", "2024-01-01", "2024-01-31")
    assert none["trend"].count() == 0 and none["peril_averages"].count() == 0 and none["trend_summary"].count() == 0
    parts["scores"].unpersist()
    none["scores"].unpersist()


def test_band_of_overall_differs_between_views(spark):
    values = [80, 80, 79, 79, 80]
    rows = [("a", dt.date(2024, 1, 1), p, s, "x") for p, s in zip(("heat", "rain", "wind", "drought", "wildfire"), values)]
    scores = spark.createDataFrame(rows, "asset_id string, date date, peril string, score int, band string")
    assert pf.all_hazards_daily(scores).first()["band"] == "Extreme"
    series = pf.batch_series_long(scores, ["heat", "rain", "wind", "drought", "wildfire"]).where("peril = 'all'").first()
    assert (series["score"], series["band"]) == (79.6, "major")


def test_export_takes_earliest_maximum(spark):
    rows = [("a", dt.date(2024, 1, d), "heat", s, [f"day {d}"]) for d, s in ((1, 5), (3, 9), (2, 9))]
    scores = spark.createDataFrame(rows, "asset_id string, date date, peril string, score int, drivers array<string>")
    assets = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "asset_id string, lat double, lon double")
    got = pf.export_asset_max(scores, assets).collect()
    assert len(got) == 1 and got[0]["score_heat"] == 9 and got[0]["top_drivers"] == "heat:day 2" and got[0]["score_wind"] == 0
