"""The registered queries and their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from workload import registry
from workload.views import BASE

SF = "/root/testdata/sf0.001"
LIGHT = ["scan_daily_features", "climatology_month", "score_heat", "batch_series", "export_asset_max", "fire_csv_normalize",
         "insert_new_fires", "province_overall", "latest_province_scores", "resolve_month_provider", "backfill_rollup_agg",
         "daily_fire_features", "stream_daily_features"]


def test_names_agree():
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries)
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"artifact_registry_files"}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_twin(spark, name):
    con = duckdb.connect()
    for base in BASE:
        con.execute(f"create view {base} as select * from '{SF}/{base}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), names)
