"""Plans that must not rest on sizes guessed before the run."""

from pyspark.sql import functions as F

from terrahaz.operators import features as ft
from terrahaz.operators import fires as fi
from terrahaz.operators import perils as pe
from terrahaz.operators import portfolio as pf
from terrahaz.operators import units
from terrahaz.sources import readers
from workload import climate
from workload.common import plain
from workload.views import Tables


def spots(spark):
    return spark.range(40).select(
        F.concat(F.lit("a"), "id").alias("asset_id"), (F.lit(36.0) + F.col("id") / 10).alias("lat"), F.lit(27.0).alias("lon"))


def detections(spark):
    return spark.range(200).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("time_utc"),
        (F.lit(36.0) + F.col("id") / 50).alias("lat"), F.lit(27.0).alias("lon"), F.col("id").cast("double").alias("frp"))


def guessed(df):
    """Broadcast joins planned before the run; the semi join with the asked days is one by request."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "BroadcastHashJoin" in line and "LeftSemi" not in line]


def test_fire_sides_are_not_broadcast_by_estimate(spark):
    """Exploded days once were as small as the files they came from, and were built on the driver."""
    days = spots(spark).withColumn("date", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-08')")))
    assert not guessed(fi.daily_fire_features(days, detections(spark)))
    assert not guessed(fi.spot_day_fires(days.select("lat", "lon", "date"), detections(spark)))
    moments = days.withColumn("window_end", F.col("date").cast("timestamp")).drop("date")
    features = fi.asset_fire_features(moments, detections(spark))
    assert not guessed(features)
    assert features.count() == 320


def test_files_are_not_dealt_to_one_task_each(spark):
    """Flags of a handful of files meet the rows where they are; a shuffle by file would read each in one task."""
    rows = [("kelvin", 300.0, 0.001), ("kelvin", 290.0, 0.002), ("plain", 20.0, 40.0), (None, 21.0, 30.0)]
    raw = spark.createDataFrame(rows, "file_id string, temp_max double, precip_sum double")
    out = units.normalize_units(raw, "file_id", ["temp_max"], ["precip_sum"])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert sorted((round(r["temp_max"], 2), r["precip_sum"]) for r in out.collect()) == [
        (16.85, 2.0), (20.0, 40.0), (21.0, 30.0), (26.85, 1.0)]


def test_pairs_of_one_node_are_made_in_several_tasks(spark):
    """Small in bytes, the readings of a node once were merged into one task that made all pairs."""
    grid = spark.range(400).select(
        F.lit(36.0).alias("lat"), F.lit(26.0).alias("lng"), F.lit("t").alias("variable"), F.col("id").cast("double").alias("value"),
        F.lit("2024-01-01").cast("timestamp").alias("time"))
    points = spark.range(50).select(F.col("id").alias("point_id"), F.lit(36.1).alias("lat"), F.lit(26.1).alias("lon"))
    out = ft.hourly_point_sample(grid, points)
    assert out.count() == 20_000 and out.distinct().count() == 20_000
    assert out.groupBy(F.spark_partition_id()).count().count() > 1


def test_instants_are_text_before_they_meet_points(spark, tmp_path):
    """Each pair of a reading and a point once made the text of the reading's time anew."""
    spark.range(130).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 10:20:30' AS ts", "if(id = 7, null, id) AS user_id", "'view' AS event_type",
        "if(id = 3, null, 1.5E0) AS value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(60).selectExpr("if(id = 9, null, id) AS c_custkey", "'m' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    out = climate.QUERIES["hourly_point_sample"](Tables(spark, str(tmp_path)))
    above, below = optimized(out).split("Join", 1)
    assert "as string) AS time" not in above and "as string) AS time" in below
    t = Tables(spark, str(tmp_path))
    late = plain(ft.hourly_point_sample(t.v_grid, t.v_assets.select(F.col("asset_id").alias("point_id"), "lat", "lon")))
    assert out.schema == late.schema and out.count() > 0
    assert sorted(map(str, out.collect())) == sorted(map(str, late.collect()))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_persisted_frames_are_found_behind_other_views(spark, tmp_path):
    """A view made as a CTE renumbered those after it, so thresholds were computed again wherever features stood before them."""
    spark.range(4).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "cast(id AS int) AS l_linenumber", "1E0 AS l_quantity", "1E0 AS l_discount",
        "1E0 AS l_tax", "timestamp'2000-01-01 00:00:00' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    features = t.v_features
    kept = t.v_features.groupBy("lat", "lng").agg(F.max("temp_max").alias("top")).persist()
    joined = features.join(kept, ["lat", "lng"])
    assert "InMemoryRelation" in optimized(joined) and joined.count() == 4
    kept.unpersist()


def test_entries_are_finished_before_they_become_rows(spark):
    """Inside the generator a score was evaluated once for each of its uses, in a method too long to be compiled."""
    rows = spark.range(3).selectExpr(
        "1E0 AS lat", "2E0 AS lng", "date'2024-01-01' AS date", "cast(id AS double) AS sum30", "0.1E0 AS soil30",
        "20E0 AS precip_30d_p10", "0.2E0 AS soil_moisture_p10")
    out = pe.weather_scores(rows, ["drought"])
    generate = next(line for line in optimized(out).splitlines() if "Generate" in line)
    assert "rint" not in generate and "format_string" not in generate
    assert [r["score"] for r in out.orderBy("score").collect()] == [72, 75, 78]


def test_fire_texts_are_read_once(spark):
    """Every filter below the parsing and each of three passes over the batch read the texts again."""
    raw = spark.range(6).selectExpr(
        "id AS arrival", "if(id = 5, 'bad', cast(40 + id % 2 AS string)) AS latitude", "'30' AS longitude", "'2024-01-04' AS acq_date",
        "cast(100 + id % 2 AS string) AS acq_time", "cast(id AS string) AS frp", "'nominal' AS confidence", "'N' AS satellite")
    fires = readers.fire_csv_normalize(raw, (42.0, 26.0, 36.0, 45.0), "2024-01-01", "2024-01-31", extra=("arrival",)).withColumn(
        "source", F.lit("s"))
    assert not [line for line in optimized(fires).splitlines() if "Filter" in line and "yyyy-M-d" in line]
    stored = fires.limit(0).select("source", *fi.FIRE_KEY)
    fresh = fi.insert_new_fires(fires, stored, "arrival", "j")
    assert "InMemoryRelation" in optimized(fresh)
    assert sorted((r["lat"], r["frp"]) for r in fresh.collect()) == [(40.0, 4.0), (41.0, 3.0)]


def test_export_does_not_sort_all_scores(spark):
    """A maximum of texts sorted every row of a task; now rows stream past the maximum of a number."""
    scores = spark.sql("""
        select * from values ('a', date'2024-01-02', 'heat', 9, array('second')), ('a', date'2024-01-01', 'heat', 9, array('first')),
            ('a', date'2024-01-03', 'heat', 5, array('late')), ('a', null, 'rain', 7, array('no day')), ('a', date'2024-01-09', 'rain', 7, array('day')),
            ('b', date'2024-01-01', null, 8, array('no peril')), ('c', date'2024-01-01', 'wind', null, array('no score')),
            (null, date'2024-01-01', 'heat', 3, array('nobody')) as t(asset_id, date, peril, score, drivers)""")
    assets = spark.createDataFrame([(i, 1.0, 2.0) for i in "abcd"], "asset_id string, lat double, lon double")
    out = pf.export_asset_max(scores, assets)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in text and "ShuffledHashJoin" in text
    assert sorted((r["asset_id"], r["score_heat"], r["score_precip"], r["top_drivers"]) for r in out.collect()) == [
        ("a", 9, 7, "heat:first | rain:day"), ("b", 0, 0, ""), ("c", 0, 0, "wind:no score")]
