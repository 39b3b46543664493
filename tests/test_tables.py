import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from terrahaz.operators import catalog as ct
from terrahaz.operators import ledgers as lg
from terrahaz.operators import notices as nt
from terrahaz.operators import province as pv
from terrahaz.operators import quality
from terrahaz.operators import thresholds as th
from terrahaz.sources import readers, sinks
from terrahaz.sources.provinces import read_provinces
from terrahaz.streaming import jobs

from test_scoring import DAYS, EIGHT, MONTHLY


def test_object_keys(spark):
    keys = ["e5.oper.an.sfc/194001/e5.oper.an.sfc.128_167_2t.ll025sc.1940010100_1940013123.nc",
            "e5.oper.fc.sfc.accumu/194001/e5.oper.fc.sfc.accumu.128_142_lsp.ll025sc.1940010106_1940011606.nc", "readme.txt"]
    got = [tuple(r)[1:] for r in ct.object_listing_parse(spark.createDataFrame([(k,) for k in keys], "key string")).collect()]
    assert got[0] == ("e5.oper.an.sfc", "2m_temperature", 1940, 1, 1)
    assert got[1] == ("e5.oper.fc.sfc.accumu", "large_scale_precipitation", 1940, 1, 1)
    assert got[2] == (None,) * 5


def test_provider_needs_every_variable(spark):
    have = ["2m_temperature", "10m_u_component_of_wind", "10m_v_component_of_wind", "large_scale_precipitation", "convective_precipitation"]
    objects = [(2020, 1, v) for v in [*have, "volumetric_soil_water_layer_1"]] + [(2020, 2, v) for v in have]
    df = spark.createDataFrame(objects, "year int, month int, variable string")
    got = {r["month"]: (r["provider"], r["reason"], str(r["end_date"])) for r in ct.resolve_month_provider(
        spark, df, "2020-01", "2020-03", list(ct.CORE_VARIABLES)).collect()}
    assert got["2020-01"] == ("aws", "all_vars_available", "2020-01-31")
    assert got["2020-02"] == ("cds", "missing_vars=volumetric_soil_water_layer_1", "2020-02-29")
    assert got["2020-03"][0] == "cds"
    latest = {r["variable"]: r["latest_month"] for r in ct.catalog_latest(df).collect()}
    assert latest["total_precipitation"] == "2020-02" and latest["volumetric_soil_water_layer_1"] == "2020-01"
    assert {r["latest_common_month"] for r in ct.catalog_latest(df).collect()} == {"2020-01"}


def test_equal_requests_have_equal_signatures(spark):
    df = spark.createDataFrame([(1, ["b", "a"], [42.00001, 26.0]), (2, ["a", "b"], [42.0, 26.0]), (3, ["a", "c"], [42.0, 26.0])],
                               "n int, variables array<string>, bbox array<double>")
    got = lg.request_dedupe(df, ["variables", "bbox"], ["n"], ("variables",), ("bbox",))
    assert sorted(r["n"] for r in got.collect()) == [1, 3]


def test_backfill_rollup_waits_for_unknown_jobs(spark):
    items = spark.createDataFrame([("b", "2015-01", "j1", "queued", "aws"), ("b", "2015-02", "j2", "queued", "aws"), ("c", "2015-01", None, "queued", "cds")],
                                  "backfill_id string, month string, job_id string, status string, provider_selected string")
    jobs_ = spark.createDataFrame([("j1", "success", None, None), ("j2", "fail_dq", "bad", None)], "job_id string, status string, error string, finished_at timestamp")
    got = {r["backfill_id"]: r for r in lg.backfill_rollup_agg(lg.backfill_rollup(items, jobs_)).collect()}
    assert (got["b"]["status"], got["b"]["months_success"], got["b"]["failed_months"]) == ("failed", 1, ["2015-02"])
    assert got["c"]["status"] == "running"


def test_empty_ledgers(spark):
    jobs_ = spark.createDataFrame([], "created_at timestamp, status string, duration_seconds double, bytes_downloaded bigint")
    assert tuple(lg.job_metrics(jobs_, "2024-01-01 00:00:00").first()) == (0, 0.0, 0.0, 0)
    runs = spark.createDataFrame([], "run_id string, status string, rows_written int, started_at timestamp")
    assert tuple(lg.latest_pipeline_run(runs).first()) == (None, "unknown", 0)


def rain(spark, values):
    start = dt.date(2020, 1, 1)
    return spark.createDataFrame([("p", start + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "province_id string, date date, rain double")


def reference_scores(history):
    """Plain-number form of the province model for one history."""
    def mean(x):
        return sum(x) / len(x)

    r7, r60 = sum(history[-7:]), sum(history[-60:])
    sums = [sum(history[i - 7:i]) for i in range(7, len(history) + 1)]
    base7 = mean(sums[:-1]) if len(sums) > 1 else (sums[-1] if sums else 1.0)
    base60 = mean([sum(history[i - 60:i]) for i in range(60, len(history) - 1)]) if len(history) >= 120 else max(1.0, r60)
    flood = round(max(0, min(100, (r7 / max(1.0, base7) - 0.5) * 80)))
    drought = round(max(0, min(100, max(0, min(1, 1 - r60 / max(1.0, base60))) * 120)))
    return flood, drought, round(0.65 * flood + 0.35 * drought)


@pytest.mark.parametrize("n", [30, 119, 120, 121, 150])
def test_province_scores_of_every_prefix(spark, n):
    values = [(i * 7 % 13) * (1 if i < 90 else 0.25) for i in range(n)]
    got = pv.score_provinces(rain(spark, values)).orderBy("as_of_date").collect()
    assert len(got) == n
    for i, r in enumerate(got):
        assert (r["flood_score"], r["drought_score"], r["overall_score"]) == reference_scores(values[: i + 1]), i


def test_dry_short_history_scores_full_drought_and_29_days_none(spark):
    got = pv.score_provinces(rain(spark, [0.0] * 30)).orderBy(F.col("as_of_date").desc()).first()
    assert got["drought_score"] == 100 and got["trend"] == "STABLE"
    assert pv.score_provinces(rain(spark, [1.0] * 29)).count() == 0


def test_trend(spark):
    got = pv.province_trend(pv.province_rolling(rain(spark, [0.0] * 20 + [3.0] * 20))).orderBy("date").collect()
    assert (got[12]["trend"], got[22]["trend"], got[22]["trend_pct"], got[39]["trend"]) == ("STABLE", "UP", 100.0, "STABLE")


def test_advice_default_and_levels(spark):
    df = spark.createDataFrame([(10, 10, "LOW", "STABLE"), (80, 55, "HIGH", "UP")], "flood_score int, drought_score int, risk_level string, trend string")
    calm, bad = [r["recommendations"] for r in pv.recommendations(df).collect()]
    assert calm == [pv.ADVICE["none"][0]] and len(bad) == 6


def test_map_names_fall_back_to_lower_case(spark):
    risks = spark.createDataFrame([(1, "İzmir", "Izmir", 60), (2, "Van", "Van", 40)], "seq int, name string, name_en string, risk int")
    regions = spark.createDataFrame([("Izmir",), ("VAN",), ("Nowhere",)], "region_name string")
    got = {r["region_name"]: (r["risk_score"], r["province_name"]) for r in pv.map_name_join(regions, risks).collect()}
    assert got == {"Izmir": (60, "Izmir"), "VAN": (40, "Van"), "Nowhere": (0, "Nowhere")}


def test_province_list(spark):
    rows = read_provinces(spark).collect()
    assert len(rows) == 81 and {r["plate"] for r in rows} == set(range(1, 82))
    assert all(r["insured_assets"] == r["population"] * 18000 for r in rows)


def test_feature_quality(spark):
    def report(*values):
        df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, 1.0, 1.0, *v) for v in values], DAYS)
        return quality.feature_dq(df).first()

    assert report((20.0, 1.0, 2.0, 0.3))["dq_status"] == "pass"
    assert report((61.0, 1.0, 2.0, None))["warnings"] == ["temp_max above expected range: 61.0"]
    assert report((20.0, -1.0, 2.0, 0.3))["dq_status"] == "fail_dq"
    assert report()["dq_status"] == "fail"
    verdict = spark.createDataFrame([(None, 20.0, 0.0, 0.06), (-81.0, 20.0, 0.0, 0.0)], "temp_c_min double, temp_c_max double, precip_min double, missing_ratio double")
    assert quality.ingest_dq_status(verdict).first()[0] == "fail"
    assert quality.ingest_dq_status(verdict.limit(1)).first()[0] == "warn"


def test_fire_csv_defects(spark, tmp_path):
    text = """latitude,longitude,acq_date,acq_time,frp,confidence,instrument
37.0,28.0,2024-01-05,305,12.5,n,VIIRS
37.1,28.1,2024-01-05,9999,,,VIIRS
x,28.1,2024-01-05,0000,1,n,VIIRS
37.2,28.2,,0000,1,n,VIIRS
50.0,28.2,2024-01-05,0000,1,n,VIIRS
37.3,28.3,2024-02-05,0000,1,n,VIIRS
37.123456,28.0,2024-01-06,12345,oops,n,
"""
    (tmp_path / "f.csv").write_text(text)
    raw = readers.read_fire_csv(spark, str(tmp_path / "f.csv"))
    got = readers.fire_csv_normalize(raw, (42.0, 26.0, 36.0, 45.0), "2024-01-01", "2024-01-31").orderBy("time_utc", "lat").collect()
    assert [(str(r["time_utc"]), r["frp"], r["satellite"]) for r in got] == [
        ("2024-01-05 00:00:00", None, "VIIRS"), ("2024-01-05 03:05:00", 12.5, "VIIRS"), ("2024-01-06 00:00:00", None, None)]
    assert got[2]["lat_round"] == 37.1235 and got[1]["geom_wkt"] == "POINT(28.0 37.0)"


def test_daily_json_ragged(spark):
    body = json.dumps({"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [5], "precipitation_sum": [None, 2.5, 9]}})
    df = spark.createDataFrame([("a", body), ("b", "{}")], "id string, j string")
    got = [(str(r["date"]), r["temp_mean"], r["temp_max"], r["precip_sum"]) for r in readers.daily_json_to_rows(df, "j", ["id"]).orderBy("date").collect()]
    assert got == [("2024-01-01", None, 5.0, None), ("2024-01-02", None, None, 2.5)]
    assert [r["rain"] for r in readers.daily_json_rain(df, "j", ["id"]).orderBy("id").collect()] == [[0.0, 2.5, 9.0], []]


def test_payload_that_is_no_json(spark):
    df = spark.createDataFrame([("1", '{"a": 1}'), ("2", "oops"), ("3", None)], "id string, payload string")
    got = [r[0] for r in nt.parse_payload(df).orderBy("id").select(F.to_json("payload")).collect()]
    assert got == ['{"a":1}', '{"raw":"oops"}', "{}"]


def test_climatology_rebuild_clears_both_levels(spark, tmp_path):
    path = str(tmp_path / "c")
    month = spark.createDataFrame([("v1", 1.0, 1.0, 1, *EIGHT), ("v2", 1.0, 1.0, 1, *EIGHT)], MONTHLY)
    doy = month.withColumnRenamed("month", "doy").where("climatology_version = 'v1'")
    sinks.sink_climatology(month, path, "month")
    sinks.sink_climatology(doy, path, "doy")
    assert sinks.read_climatology(spark, path, "doy").count() == 1
    left = sinks.read_climatology(spark, path, "month").collect()
    assert [r["climatology_version"] for r in left] == ["v2"]


def test_scores_are_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "s")
    schema = "asset_id string, peril string, score int, climatology_version string, date date"
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    old = spark.createDataFrame([(a, "heat", 1, v, d) for a in "ab" for v in ("v1", "v2") for d in days], schema)
    assets = spark.createDataFrame([("a",)], "asset_id string")
    table = sinks.scores_table(old, path)
    sinks.write_scores(table, old, spark.createDataFrame([("a",), ("b",)], "asset_id string"), days[0], days[2], "v1")
    fresh = spark.createDataFrame([("a", "heat", 9, "v1", days[0])], schema)
    sinks.write_scores(table, fresh, assets, days[0], days[1], "v1")
    got = sorted((r["asset_id"], r["climatology_version"], str(r["date"]), r["score"]) for r in table.read().collect())
    assert ("a", "v1", "2024-01-01", 9) in got and ("a", "v1", "2024-01-02", 1) not in got
    assert ("a", "v1", "2024-01-03", 1) in got and ("b", "v1", "2024-01-02", 1) in got
    assert sum(r[1] == "v2" for r in got) == 6


def test_feature_files_by_month(spark, tmp_path):
    path = str(tmp_path / "f")
    frame = spark.createDataFrame([(dt.date(2024, m, 5), 1.0, 1.0, 1.0, float(m), 1.0, 1.0, 0.1) for m in (1, 2, 3)], DAYS)
    sinks.sink_features_month(frame, path)
    got = readers.read_feature_files(spark, path, "2024-02-01", "2024-03-31")
    assert sorted(r["temp_max"] for r in got.collect()) == [2.0, 3.0]
    assert got.where(F.col("file_id").isNull() | F.col("written_at").isNull()).count() == 0


def test_alert_stream_replay_is_harmless(spark, tmp_path):
    assets = spark.createDataFrame([("p", "a", 37.0, 27.0)], "portfolio_id string, asset_id string, lat double, lon double")
    schema = "time_utc timestamp, lat double, lon double, frp double"
    batches = [spark.createDataFrame([(dt.datetime(2024, 1, 10, h), 37.0, 27.0, 1.0)], schema) for h in (10, 12)]
    handle = jobs.fire_alert_handler(assets, str(tmp_path / "fires"), str(tmp_path / "notices"), str(tmp_path / "watched"))
    handle(batches[0].limit(0), 0)
    handle(batches[0], 1)
    handle(batches[1], 2)
    handle(batches[1], 2)
    handle(batches[0].unionByName(batches[1]), 3)  # nothing new
    assert jobs.stored_rows(spark, str(tmp_path / "fires")).count() == 2
    assert jobs.notice_table(spark, str(tmp_path / "notices")).read().count() == 1


def test_late_and_repeated_batches_lose_nothing(spark, tmp_path):
    def at(day, hour):
        return dt.datetime(2024, 1, day, hour)

    schema = "source string, time_utc timestamp, lat_round double, lon_round double, lat double, lon double, frp double"
    rows = [("S", at(d, 5), 37.0, 27.0, 37.0, 27.0, float(d)) for d in (20, 2, 21)]
    batches = [spark.createDataFrame([r], schema) for r in rows]  # the second is 18 days late
    fires, counts = str(tmp_path / "fires"), str(tmp_path / "counts")
    keep, count = jobs.fire_handler(fires), jobs.fire_count_handler(counts)
    keep(batches[0].limit(0), 0)
    for n, b in enumerate([*batches, batches[2]]):
        keep(b, min(n, 2) + 1)  # the last one is replayed
        count(b, min(n, 2) + 1)
    keep(batches[1], 4)  # stored already
    assert sorted(r["frp"] for r in jobs.stored_rows(spark, fires).collect()) == [2.0, 20.0, 21.0]
    got = {r["window_start"].day: r["n"] for r in jobs.fire_counts(jobs.stored_rows(spark, counts)).where("window_start >= '2024-01-01'").collect()}
    assert got == {1: 1, 2: 1, 14: 1, **{d: 2 for d in range(15, 21)}, 21: 1}

    hours = "time timestamp, point_id string, lat double, lng double, variable string, value double, tie long"
    readings = [(at(20, 5), 280.0, 2), (at(20, 6), 290.0, 3), (at(20, 5), 270.0, 1)]  # a late one that comes first in its hour
    store = str(tmp_path / "hours")
    for n, (time, value, tie) in enumerate(readings):
        jobs.hourly_handler(store)(spark.createDataFrame([(time, "p", 1.0, 2.0, "2m_temperature", value, tie)], hours), n)
    day = jobs.daily_features(jobs.stored_rows(spark, store)).collect()
    assert [(r["temp_mean"], r["temp_max"]) for r in day] == [(280.0, 290.0)]
