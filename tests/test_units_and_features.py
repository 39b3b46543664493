import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrahaz.functions.quantiles import bound_stats, quantile_above
from terrahaz.operators import features as ft
from terrahaz.operators import units


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_kelvin_and_metres(spark):
    df = spark.createDataFrame([("f", 273.15, 0.001), ("f", 283.15, 0.01), ("f", 293.15, 0.1)], "f string, t double, p double")
    got = rows(units.normalize_units(df, "f", ["t"], ["p"]).orderBy("t"))
    assert [round(r[1], 6) for r in got] == [0.0, 10.0, 20.0]
    assert [round(r[2], 6) for r in got] == [1.0, 10.0, 100.0]


def test_rules_look_at_each_file_alone_and_skip_text(spark):
    df = spark.createDataFrame(
        [("k", "280", 1.0), ("k", "x", 9.0), ("c", "12", 2.0), ("c", None, 3.0), ("empty", None, None)],
        "f string, t string, p double")
    got = {(r[0], r[1] is None): r for r in rows(units.normalize_units(df, "f", ["t"], ["p"]))}
    assert round(got[("k", False)][1], 6) == 6.85
    assert got[("c", False)][1] == 12.0
    assert got[("k", False)][2] == 1.0 and got[("c", False)][2] == 2000.0
    assert got[("empty", True)][2] is None


@pytest.mark.parametrize("q,bound", [(0.5, 150.0), (0.99, 5.0), (0.25, 3.0)])
def test_quantile_bound_equals_interpolated_quantile(spark, q, bound):
    rng = np.random.default_rng(7)
    data, want = [], {}
    for g in range(60):
        n = int(rng.integers(1, 40))
        values = rng.choice([bound - 1, bound, bound + 0.5, bound + 1, bound * 2], size=n)
        data += [(g, float(v)) for v in values]
        want[g] = bool(np.quantile(values, q) > bound)
    df = spark.createDataFrame(data, "g int, v double")
    got = df.groupBy("g").agg(*bound_stats(F.col("v"), bound, "v")).select("g", quantile_above("v", q, bound).alias("up"))
    assert {r["g"]: r["up"] for r in got.collect()} == want


def test_pivot_takes_first_present_value_and_daily_defaults_rain_to_zero(spark):
    t = dt.datetime(2020, 1, 1, 5)
    long = spark.createDataFrame(
        [(t, "p", 1.0, 2.0, "2m_temperature", None, 1), (t, "p", 1.0, 2.0, "2m_temperature", 281.15, 2),
         (t, "p", 1.0, 2.0, "2m_temperature", 999.0, 3), (t, "p", 1.0, 2.0, "10m_u_component_of_wind", 3.0, 4),
         (t, "p", 1.0, 2.0, "10m_v_component_of_wind", 4.0, 5)],
        "time timestamp, point_id string, lat double, lng double, variable string, value double, k int")
    wide = ft.pivot_variables(long, tie="k").withColumn("f", F.lit("m"))
    day = ft.hourly_to_daily(wide, "f").first()
    assert round(day["temp_mean"], 6) == 8.0 and day["precip_sum"] == 0.0
    assert day["wind_max"] == 5.0 and day["soil_moisture_mean"] is None


def test_precipitation_parts(spark):
    both = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "large_scale_precipitation double, convective_precipitation double")
    assert [r["total_precipitation"] for r in ft.precip_from_components(both).collect()] == [3.0, None]
    one = both.drop("convective_precipitation")
    assert ft.precip_from_components(one).first()["total_precipitation"] == 1.0
    assert ft.precip_from_components(one.drop("large_scale_precipitation")).columns == []


def test_smoke_month_of_three_points_gives_93_days(spark):
    hours = spark.range(31 * 24).select(
        (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("time"))
    points = spark.createDataFrame([("a", 41.0, 29.0), ("b", 40.0, 33.0), ("c", 38.0, 27.0)], "point_id string, lat double, lng double")
    frame = hours.join(points.withColumn("z", F.lit(1)), F.col("z") == 1).drop("z").withColumns({"2m_temperature": F.lit(280.0), "m": F.lit("2020-01")})
    assert ft.hourly_to_daily(frame, "m").count() == 93


def test_grid_daily_mean_decides_for_the_maximum(spark):
    t = dt.datetime(2020, 1, 1)
    frame = spark.createDataFrame([(t, 1.0, 1.0, 100.0, "f"), (t.replace(hour=1), 1.0, 1.0, 180.0, "f")],
                                  "time timestamp, lat double, lng double, `2m_temperature` double, f string")
    got = ft.hourly_to_daily_grid(frame, "f").first()
    assert got["temp_mean"] == 140.0 and got["temp_max"] == 180.0


def test_half_way_points_go_to_the_larger_grid_line(spark):
    grid = spark.createDataFrame([(36.0, 26.0), (37.0, 28.0)], "lat double, lng double")
    points = spark.createDataFrame([("m", 36.5, 27.0), ("l", 36.4, 20.0)], "point_id string, lat double, lon double")
    got = {r["point_id"]: (r["grid_lat"], r["grid_lng"]) for r in ft.nearest_axis_sample(points, grid).collect()}
    assert got == {"m": (37.0, 28.0), "l": (36.0, 26.0)}


def test_lead_hours_move_the_time(spark):
    grid = spark.createDataFrame([(dt.datetime(2020, 1, 1, 18), 9, 36.0, 26.0, "2m_temperature", 1.5)],
                                 "init_time timestamp, lead_hours int, lat double, lng double, variable string, value double")
    points = spark.createDataFrame([("a", 36.2, 26.3)], "point_id string, lat double, lon double")
    got = ft.hourly_point_sample(grid, points).first()
    assert got["time"] == dt.datetime(2020, 1, 2, 3) and (got["lat"], got["lng"]) == (36.2, 26.3)


def test_points_union_last_portfolio_wins_and_ids_are_padded(spark):
    assets = spark.createDataFrame([("p1", "x", 1.0, 1.0), ("p2", "x", 2.0, 2.0)], "portfolio_id string, asset_id string, lat double, lon double")
    provinces = spark.createDataFrame([(7, 36.9, 30.7), (34, 41.0, 28.9)], "plate int, lat double, lng double")
    got = {r["point_id"]: r["lat"] for r in ft.points_union(assets, provinces, "assets+provinces").collect()}
    assert got == {"asset:x": 2.0, "province:07": 36.9, "province:34": 41.0}
    assert ft.points_union(assets, provinces, "other").count() == 0
