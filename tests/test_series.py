"""Series of many points over files that share grids."""

import random

from terrahaz.operators import features as ft

RAW = "date string, file_id int, k1 int, lat double, lng double, temp_mean double"


def test_files_with_the_same_cells_share_a_grid(spark):
    cells = [(1, 1.0, 2.0), (1, 3.0, 4.0), (2, 3.0, 4.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (4, 2.0, 1.0), (5, -0.0, 1.0), (6, 0.0, 1.0)]
    df = spark.createDataFrame(cells, "file_id int, lat double, lng double")
    grid = {r["file_id"]: r["grid"] for r in ft.file_grids(df.repartition(3), "file_id").collect()}
    assert grid[1] == grid[2] and grid[5] == grid[6]
    assert len({grid[i] for i in (1, 3, 4, 5)}) == 4


def _plain(assets, rows, start, end):
    out = []
    cells = {}
    for _, f, _, lat, lng, _ in rows:
        cells.setdefault(f, set()).add((lat, lng))
    for name, lat, lng in assets:
        lat, lng = round(lat, 3), round(lng, 3)
        near = {f: min(c, key=lambda p: (abs(p[0] - lat) + abs(p[1] - lng), *p)) for f, c in cells.items()}
        days = {}
        for day, f, k, a, b, value in rows:
            if start <= day <= end and near[f] == (a, b):
                days[day] = max(days.get(day, (-1,)), (f, k, value))
        out += [(name, day, best[2]) for day, best in days.items()]
    return sorted(out)


def test_series_equal_brute_force_whatever_files_share(spark):
    rng = random.Random(6)
    grids = [[(rng.randrange(8) / 2, rng.randrange(8) / 2) for _ in range(6)] for _ in range(3)]
    rows = []
    for f in range(12):
        for lat, lng in set(grids[f % 3]):
            rows += [(f"2024-01-{rng.randrange(1, 9):02d}", f, rng.randrange(10 ** 6), lat, lng, float(rng.randrange(10 ** 6))) for _ in range(4)]
    assets = [(f"a{i}", rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(25)] + [("twin", 1.0004, 1.0), ("twin2", 1.0, 1.0)]
    raw = spark.createDataFrame(rows, RAW).selectExpr("to_date(date) as date", "file_id", "k1", "lat", "lng", "temp_mean").repartition(4)
    asked = spark.createDataFrame(assets, "asset_id string, lat double, lng double")
    for start, end in (("2024-01-01", "2024-01-08"), ("2024-01-03", "2024-01-04"), ("2025-01-01", "2025-01-02")):
        got = ft.batch_point_timeseries(asked, raw, start, end, "file_id", ["file_id", "k1"])
        assert sorted((r["asset_id"], str(r["date"]), r["temp_mean"]) for r in got.collect()) == _plain(assets, rows, start, end)


def test_no_step_pairs_positions_with_files(spark):
    """200 files of one grid: no operator makes more rows than positions and grids explain."""
    cells = [(float(i % 10), float(i // 10)) for i in range(100)]
    rows = [(f"2024-01-{1 + f % 5:02d}", f, 0, lat, lng, 1.0) for f in range(200) for lat, lng in cells]
    raw = spark.createDataFrame(rows, RAW).selectExpr("to_date(date) as date", "file_id", "k1", "lat", "lng", "temp_mean")
    grids = ft.file_grids(raw.select("file_id", "lat", "lng").distinct(), "file_id")
    assert grids.select("grid").distinct().count() == 1
    asked = spark.range(500).selectExpr("concat('a', id) as asset_id", "id % 10 + 0.1 as lat", "id % 7 + 0.2 as lng")
    assert ft.batch_point_timeseries(asked, raw, "2024-01-01", "2024-01-31", "file_id", ["file_id", "k1"]).count() == 500 * 5


def test_files_outside_the_range_are_not_opened(spark, tmp_path):
    from pyspark.sql import functions as F

    from terrahaz.sources import readers
    path = str(tmp_path / "files")
    days = spark.range(720).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("v"))
    days.withColumn("part", F.year("date") * 12 + F.month("date")).repartition("part").write.partitionBy("part").parquet(path)
    ledger = readers.feature_ledger(spark, path).persist()
    assert ledger.agg(F.sum("row_count")).first()[0] == 720
    got = readers.read_ledger_files(spark, path, ledger, "2000-03-15", "2000-04-02")
    assert len(got.inputFiles()) == 2 and got.count() == 61
    assert readers.read_ledger_files(spark, path, ledger, "2010-01-01", "2010-04-02").count() == 0
    ledger.unpersist()
