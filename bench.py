"""Headline timings.  Prints one JSON line.

The scoring recipe is the published one (100 assets x 90 days, four perils,
features and thresholds read from stored tables), then 5,000 assets, then every
customer as an asset.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrahaz.functions.numbers import DEFAULT_PERILS
from terrahaz.operators import features as ft
from terrahaz.operators import fires as fi
from terrahaz.operators import portfolio as pf
from terrahaz.operators import province as pv
from terrahaz.operators import thresholds as th
from terrahaz.plans.scoring import batch_scores
from terrahaz.session import local_session
from terrahaz.sources import sinks
from terrahaz.sources.readers import stored_features
from workload import climate
from workload.common import BASELINE, VERSION, WHOLE
from workload.views import Tables

START, END, DAYS = "2000-01-01", "2000-03-30", 90
FIRE_DAYS = ("2024-01-08", "2024-01-14")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8, "20g")
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    store = tempfile.mkdtemp(prefix="terrahaz-bench-")
    took: dict[str, float] = {}

    def timed(name: str, work) -> None:
        began = time.time()
        work()
        took[name] = round(time.time() - began, 3)

    t.lineitem.agg(F.count("*")).collect()
    timed("build_daily_features", lambda: sinks.sink_features_month(
        ft.scan_daily_features(t.v_features_raw, *WHOLE, "file_id", climate.NEWEST).drop("month"), f"{store}/features"))
    features = stored_features(spark, f"{store}/features", START, END)
    baseline = stored_features(spark, f"{store}/features", *BASELINE)
    timed("build_climatology", lambda: sinks.sink_climatology(
        th.build_climatology(baseline, *BASELINE, VERSION), f"{store}/climatology", "month"))
    monthly = sinks.read_climatology(spark, f"{store}/climatology", "month")
    assets = t.v_assets.select("asset_id", "lat", "lon").orderBy("asset_id").cache()
    counts = [100, 5000, assets.count()]

    def score(n: int) -> DataFrame:
        return batch_scores(features, assets.limit(n), monthly, None, START, END, VERSION, list(DEFAULT_PERILS))

    per_asset: dict[str, dict[str, float]] = {}
    for n in counts:
        name = f"batch_scores_{n}x{DAYS}"
        timed(name, lambda: run(score(n)))
        per_asset[name] = {"per_asset_ms": round(took[name] / n * 1000, 3),
                           "per_asset_day_ms": round(took[name] / (n * DAYS) * 1000, 5)}
    scored = score(5000).drop("exposure")
    timed("store_scores", lambda: sinks.write_scores(
        sinks.scores_table(scored, f"{store}/scores"), scored, assets, START, END, VERSION))
    scores = t.v_scores
    hazards = pf.all_hazards_daily(scores)
    timed("portfolio_summary", lambda: [run(d) for d in (
        pf.band_counts(hazards), pf.peril_averages(scores), pf.trend_by_date(scores), pf.top_assets(scores, t.v_assets))])
    timed("hourly_to_daily", lambda: run(climate.daily_points(t)))
    days = F.explode(F.sequence(F.lit(FIRE_DAYS[0]).cast("date"), F.lit(FIRE_DAYS[1]).cast("date")))
    timed("asset_fire_features", lambda: run(fi.daily_fire_features(assets.withColumn("date", days), t.v_fires)))
    timed("province_scores", lambda: run(pv.score_provinces(t.v_rain)))
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "scoring": per_asset, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
