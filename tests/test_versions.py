"""Versioned tables: what changes, what stays, what a crash leaves."""

import pytest
from pyspark.sql import functions as F

from terrahaz.sources import sinks
from terrahaz.sources.versions import VersionedTable, among

SCHEMA = "day date, source string, id int, value double"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return VersionedTable(spark, str(tmp_path / "table"), schema, ["day"])


def _rows(spark, rows):
    return spark.createDataFrame(rows, "day string, source string, id int, value double").withColumn("day", F.to_date("day"))


def _all(frame):
    return sorted((str(r["day"]) if r["day"] else None, r["source"], r["id"], r["value"]) for r in frame.collect())


A, B, C = ("2024-01-01", "s", 1, 1.0), ("2024-01-02", "s", 2, 2.0), ("2024-01-02", "t", 3, 3.0)


def test_a_table_starts_empty(table):
    assert table.version() == 0 and table.read().count() == 0 and table.last_batch() is None


def test_a_change_rewrites_only_its_partitions(spark, table):
    table.add(_rows(spark, [A, B]))
    first = {h[0]: h[1] for h in table.held()}
    table.merge(_rows(spark, [C]), lambda stored, new: stored.unionByName(new))
    assert _all(table.read()) == sorted([A, B, C])
    after = {h[0]: h[1] for h in table.held()}
    assert [after[d] == first[d] for d in sorted(after)] == [True, False]


def test_partitions_left_without_rows_vanish(spark, table):
    table.add(_rows(spark, [A, B]))
    table.replace(_rows(spark, []), F.col("day") == F.lit("2024-01-02").cast("date"))
    assert _all(table.read()) == [A] and len(table.held()) == 1


@pytest.mark.parametrize("step", ["data", "pointer"])
def test_a_crash_between_the_steps_changes_nothing(spark, table, step, monkeypatch):
    table.add(_rows(spark, [A, B]))
    from pyspark.sql import DataFrameWriter
    whole = DataFrameWriter.parquet

    def dying(self, path, *args, **more):
        if f"/{step}/" in path:
            if step == "data":
                whole(self, path, *args, **more)  # the files are there, the pointer never comes
            raise OSError("killed")
        return whole(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", dying)
    with pytest.raises(OSError):
        table.replace(_rows(spark, [C]), F.lit(True))
    monkeypatch.undo()
    assert table.version() == 1 and _all(table.read()) == sorted([A, B])
    table.replace(_rows(spark, [C]), F.lit(True))
    assert table.version() == 2 and _all(table.read()) == [C]


def test_at_most_two_files_a_day_and_batches_count_once(spark, table):
    for k in range(7):
        table.add(_rows(spark, [("2024-01-02", "s", k, float(k))]), batch=k)
        table.add(_rows(spark, [("2024-01-02", "s", k, float(k))]), batch=k)  # delivered again
        assert len(table.held()) <= 2
    assert [r[2] for r in _all(table.read())] == list(range(7)) and table.last_batch() == 6


def test_old_files_go(spark, table, tmp_path):
    for k in range(5):
        table.replace(_rows(spark, [("2024-01-02", "s", k, float(k))]), F.lit(True))
    table.vacuum()
    assert _all(table.read()) == [("2024-01-02", "s", 4, 4.0)]
    assert len(list((tmp_path / "table" / "data").glob("*"))) == 2


def test_only_named_folders_are_read(spark, table):
    table.add(_rows(spark, [A, B, ("2024-01-09", "s", 5, 5.0)]))
    plan = table.read(F.col("day") == F.lit("2024-01-09").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-01-09" in plan.split("PartitionFilters")[1].split("]")[0]


def test_several_partition_columns_and_nulls(spark, tmp_path):
    schema = spark.createDataFrame([], "v string, n int, x int").schema
    table = VersionedTable(spark, str(tmp_path / "two"), schema, ["v", "n"])
    rows = [("a=b/c", 1, 1), ("a=b/c", 2, 2), (None, 1, 3), ("z", None, 4)]
    table.add(spark.createDataFrame(rows, schema))
    table.merge(spark.createDataFrame([(None, 1, 30)], schema), lambda stored, new: new)
    assert sorted(r["x"] for r in table.read().collect()) == [1, 2, 4, 30]
    assert [r["x"] for r in table.read(among(["v", "n"], [("a=b/c", 2)])).collect()] == [2]


def test_late_pages_come_from_their_ranges(spark, tmp_path):
    from terrahaz.operators import ledgers as lg
    path = str(tmp_path / "ranges")
    rows = spark.range(1000).selectExpr("id % 7 as score", "id", "id % 3 as other")
    lg.store_ranges(rows, path, "score", False, ["id"])
    for page in (1, 2, 13, 40, 41):
        want = lg.table_page(rows, "score", False, page, 25, ["id"]).collect()
        assert lg.stored_page(spark, path, "score", False, page, 25, ["id"]).collect() == want
    one = lg.stored_page(spark, path, "score", False, 1, 5, ["id"])
    assert len({f.split("range_no=")[1].split("/")[0] for f in one.inputFiles()}) <= len({
        f.split("range_no=")[1].split("/")[0] for f in spark.read.parquet(path).inputFiles()})


def test_keyed_lookup_names_the_days_and_keeps_every_match(spark, table):
    from terrahaz.operators import fires as fi
    schema = "source string, time_utc timestamp, lat_round double, lon_round double"
    import datetime as dt
    stored = [("S", dt.datetime(2024, 1, 1 + k % 9, 5), float(k), 1.0) for k in range(3000)]
    batch = [("S", dt.datetime(2024, 1, 1 + k % 9, 5), float(k), 1.0) for k in range(2, 4000, 9)]  # one day, some stored
    held = spark.createDataFrame(stored, schema).withColumn("day", F.to_date("time_utc"))
    store = VersionedTable(spark, table.path, held.schema, ["day"])
    store.add(held)
    fresh = fi.fires_anti(spark.createDataFrame(batch, schema), store.read())
    assert sorted(r["lat_round"] for r in fresh.collect()) == [float(k) for k in range(2, 4000, 9) if k >= 3000]
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = fresh.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "= 2024-01-03)" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
