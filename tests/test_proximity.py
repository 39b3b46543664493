import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrahaz.operators import fires as fi
from terrahaz.operators import notices as nt
from terrahaz.operators.nearest import nearest_cell, nearest_sites


def km(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(max(1e-12, 1 - h)))


def test_nearest_cell_equals_brute_force_far_and_near(spark):
    rng = np.random.default_rng(3)
    cells = [(round(36 + 0.25 * i, 2), round(26 + 0.25 * j, 2)) for i in range(12) for j in range(12) if rng.random() < 0.5]
    points = [(f"p{i}", float(la), float(ln)) for i, (la, ln) in enumerate(
        [*rng.uniform((30, 20), (45, 40), (150, 2)), (0.0, 0.0), (-89.0, 179.0), (90.0, -180.0), (36.125, 26.125)])]
    points += [(f"hot{i}", 0.0, 0.0) for i in range(60)]
    got = {r["point_id"]: (r["cell_lat"], r["cell_lng"]) for r in nearest_cell(
        spark.createDataFrame(points, "point_id string, lat double, lng double"),
        spark.createDataFrame(cells, "lat double, lng double")).collect()}
    for name, la, ln in points:
        assert got[name] == min(cells, key=lambda c: (abs(c[0] - la) + abs(c[1] - ln), c))


def test_equal_distances_take_the_smaller_cell(spark):
    cells = spark.createDataFrame([(37.0, 27.0), (36.0, 28.0), (36.0, 26.0)], "lat double, lng double")
    got = nearest_cell(spark.createDataFrame([("p", 36.0, 27.0)], "point_id string, lat double, lng double"), cells).first()
    assert (got["cell_lat"], got["cell_lng"]) == (36.0, 26.0)


def test_groups_without_sites_drop_out(spark):
    points = spark.createDataFrame([(1, 1.0), (2, 1.0)], "g int, x double")
    sites = spark.createDataFrame([(1, 5.0), (1, 0.5)], "g int, y double")
    got = nearest_sites(points, sites, {"x": "y"}, ["g"]).collect()
    assert [(r["g"], r["y"], r["distance"]) for r in got] == [(1, 0.5, 0.5)]


def brute(asset, fires, end):
    out = {}
    for span, hours in (("24h", 24), ("7d", 168)):
        near = [(km(asset[1], asset[2], f[1], f[2]), f[3]) for f in fires if end - dt.timedelta(hours=hours) <= f[0] <= end]
        out[f"nearest_fire_distance_km_{span}"] = round(min(d for d, _ in near), 3) if near else None
        out[f"fires_within_10km_count_{span}"] = sum(d <= 10 for d, _ in near)
        frp = [p for d, p in near if d <= 20 and p is not None]
        out[f"max_frp_within_20km_{span}"] = round(max(frp), 3) if frp else None
    return out


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(11)
    base = dt.datetime(2024, 1, 1)
    fires = [(base + dt.timedelta(minutes=int(rng.integers(0, 14 * 1440))), float(rng.uniform(36, 38)), float(rng.uniform(26, 29)),
              None if rng.random() < 0.2 else float(rng.uniform(0, 300))) for _ in range(300)]
    edge = dt.datetime(2024, 1, 5, 23, 59, 59, 999999)
    fires += [(edge, 37.0, 27.0, 50.0), (edge, 37.0, 27.0, 70.0), (edge - dt.timedelta(microseconds=1), 37.05, 27.0, 10.0)]
    # one spot holds a third of all detections
    fires += [(base + dt.timedelta(days=3, minutes=i), 36.5, 28.0, float(i)) for i in range(150)]
    # the far side of the date line is near
    fires += [(base + dt.timedelta(days=4), 10.0, 179.99, 5.0)]
    assets = [("a0", 37.0, 27.0), ("a1", 36.5, 28.05), ("a2", 36.9, 26.5), ("far", -40.0, -70.0), ("line", 10.0, -179.99), ("twin", 37.0, 27.0)]
    return fires, assets


def frames(spark, scene):
    fires, assets = scene
    return (spark.createDataFrame(fires, "time_utc timestamp, lat double, lon double, frp double"),
            spark.createDataFrame(assets, "asset_id string, lat double, lon double"))


def check(got, want):
    for name, value in want.items():
        if value is None or isinstance(value, int):
            assert got[name] == value, name
        else:
            assert got[name] == pytest.approx(value, abs=2e-3), name


def test_daily_features_equal_brute_force(spark, scene):
    fires, assets = frames(spark, scene)
    days = F.explode(F.sequence(F.lit("2024-01-05").cast("date"), F.lit("2024-01-14").cast("date")))
    rows = fi.daily_fire_features(assets.withColumn("date", days), fires).collect()
    assert len(rows) == 60
    for r in rows:
        end = dt.datetime.combine(r["date"], dt.time.max)
        check(r, brute((r["asset_id"], r["lat"], r["lon"]), scene[0], end))


def test_moment_features_equal_brute_force(spark, scene):
    fires, assets = frames(spark, scene)
    for moment in (dt.datetime(2024, 1, 6, 12, 30), dt.datetime(2024, 1, 12, 23, 59, 59, 999999), dt.datetime(2023, 12, 1)):
        rows = fi.asset_fire_features(fi.requests_at(assets, moment), fires).collect()
        assert len(rows) == 6
        for r in rows:
            check(r, brute((r["asset_id"], r["lat"], r["lon"]), scene[0], moment))


def test_rim_of_ten_and_twenty_kilometres(spark):
    step = math.degrees(1 / 6371)
    t = dt.datetime(2024, 1, 1, 12)
    fires = [(t, 40.0 + step * d, 30.0, d) for d in (9.999, 10.001, 19.999, 20.001)]
    got = fi.asset_fire_features(
        fi.requests_at(spark.createDataFrame([("a", 40.0, 30.0)], "asset_id string, lat double, lon double"), "2024-01-01 13:00:00"),
        spark.createDataFrame(fires, "time_utc timestamp, lat double, lon double, frp double")).first()
    assert got["fires_within_10km_count_24h"] == 1 and got["max_frp_within_20km_24h"] == 19.999


def test_hotspots_around_provinces(spark, scene):
    fires, _ = frames(spark, scene)
    provinces = [("1", 37.0, 27.0), ("2", 36.5, 28.4), ("3", 0.0, 0.0)]
    got = {r["id"]: r["hits"] for r in fi.province_hotspot_count(
        spark.createDataFrame(provinces, "id string, lat double, lng double"), fires, 75.0).collect()}
    want = {p: sum(km(la, ln, f[1], f[2]) <= 75 for f in scene[0]) for p, la, ln in provinces}
    assert got == {p: n for p, n in want.items() if n}


def test_notifications_once_a_day_and_first_ack_stays(spark):
    now = "2024-01-10 12:00:00"
    fires = spark.createDataFrame([(dt.datetime(2024, 1, 10, 11), 37.0, 27.0, 1.0), (dt.datetime(2024, 1, 5), 38.0, 29.0, 1.0)],
                                  "time_utc timestamp, lat double, lon double, frp double")
    assets = spark.createDataFrame([("p", "near", 37.0, 27.01), ("p", "week", 38.05, 29.0), ("p", "far", 40.0, 40.0), ("q", "near", 37.0, 27.01)],
                                   "portfolio_id string, asset_id string, lat double, lon double")
    empty = spark.createDataFrame([], "type string, created_at timestamp, dedup_key string")
    first = nt.wildfire_notifications(assets, fires, empty, now)
    got = {(r["portfolio_id"], r["asset_id"]): r for r in first.collect()}
    assert {k: r["severity"] for k, r in got.items()} == {("p", "near"): "high", ("q", "near"): "high", ("p", "week"): "medium"}
    assert got[("p", "near")]["dedup_key"] == "p:near:wildfire_proximity:high:2024-01-10"
    assert nt.wildfire_notifications(assets, fires, first, now).count() == 0
    acked = nt.ack_notification(first, first.where("asset_id = 'near'"), "2024-01-11 00:00:00")
    again = nt.ack_notification(acked, first, "2024-01-12 00:00:00")
    assert sorted(str(r["acknowledged_at"]) for r in again.collect()) == ["2024-01-11 00:00:00", "2024-01-11 00:00:00", "2024-01-12 00:00:00"]


def test_last_copy_of_a_batch_wins_and_stored_keys_are_skipped(spark):
    t = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(t, 1.0, 2.0, "s", 1.0, 1), (t, 1.0, 2.0, "s", 2.0, 2), (t, 1.0, 3.0, "s", 3.0, 3)],
                                  "time_utc timestamp, lat_round double, lon_round double, source string, frp double, arrival int")
    stored = batch.where("lon_round = 3.0").drop("frp", "arrival")
    assert [r["frp"] for r in fi.insert_new_fires(batch, stored, "arrival", "j").collect()] == [2.0]
