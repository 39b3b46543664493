"""Object catalog: parsing keys, availability, provider choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_spine
from .features import keep_newest
from .filters import PRECIP_PARTS, PRECIP_SOURCES, accepted_variables

# Key patterns and the short names they carry.
KEY_PATTERN = r"^([^/]+)/(\d{6})/([^/]+)$"
PARAMETER_PATTERN = r"[._]128_\d{3}_([a-z0-9]+)\."
DATE_PATTERN = r"(\d{8})"
SHORT_NAMES = {
    "2t": "2m_temperature",
    "10u": "10m_u_component_of_wind",
    "10v": "10m_v_component_of_wind",
    "swvl1": "volumetric_soil_water_layer_1",
    "tp": "total_precipitation",
    "lsp": "large_scale_precipitation",
    "cp": "convective_precipitation",
}
CORE_VARIABLES = ("2m_temperature", "10m_u_component_of_wind", "10m_v_component_of_wind",
                  "total_precipitation", "volumetric_soil_water_layer_1")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def object_listing_parse(listing: DataFrame, key: str = "key") -> DataFrame:
    """Adds dataset_group, variable, year, month, day; odd keys get NULLs."""
    names = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    path = F.col(key)
    file_name = _part(path, KEY_PATTERN, 3)
    month = _part(path, KEY_PATTERN, 2)
    return listing.withColumns({
        "dataset_group": _part(path, KEY_PATTERN, 1),
        "variable": F.try_element_at(names, _part(file_name, PARAMETER_PATTERN, 1)),
        "year": F.substring(month, 1, 4).cast("int"),
        "month": F.substring(month, 5, 2).cast("int"),
        "day": F.substring(_part(file_name, DATE_PATTERN, 1), -2, 2).cast("int"),
    })


def upsert_object_catalog(stored: DataFrame, listing: DataFrame, arrival: str) -> DataFrame:
    """Catalog after a listing: one row per (bucket, key), the last listed wins.

    ``listing``: bucket, key, size, etag, last_modified, and the arrival column.
    """
    usable = listing.where(F.coalesce(F.col("key"), F.lit("")) != "")
    newest = keep_newest(usable, ["bucket", "key"], [F.col(arrival).desc()]).drop(arrival)
    parsed = object_listing_parse(newest).withColumns({
        "size": F.coalesce(F.col("size").cast("bigint"), F.lit(0)),
        "etag": F.nullif(F.regexp_replace("etag", '"', ""), F.lit("")),
    })
    kept = stored.join(parsed.select("bucket", "key"), ["bucket", "key"], "left_anti")
    return kept.unionByName(parsed.select(*stored.columns))


def month_variables(objects: DataFrame, year: int, month: int) -> DataFrame:
    return objects.where(
        (F.col("year") == year) & (F.col("month") == month) & F.col("variable").isNotNull()
    ).select("variable").distinct()


def month_objects(objects: DataFrame, year: int, month: int, required: list[str]) -> DataFrame:
    return objects.where(
        (F.col("year") == year) & (F.col("month") == month)
        & F.col("variable").isin(accepted_variables(required))
    ).select("key", "variable").orderBy("key")


def catalog_latest(objects: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Newest month per required variable (any precipitation form counts), and
    the newest month all of them reach.  One row per required variable."""
    wanted = list(required or CORE_VARIABLES)
    month = F.format_string("%04d-%02d", "year", "month")

    def newest(variable: str) -> Column:
        forms = PRECIP_SOURCES if variable == "total_precipitation" else (variable,)
        return F.max(F.when(F.col("variable").isin(*forms), month)).alias(variable)

    found = objects.where(F.col("variable").isin(accepted_variables(wanted)) & F.col("year").isNotNull()).agg(
        *[newest(v) for v in wanted])
    all_there = F.lit(True)
    for v in wanted:
        all_there = all_there & F.col(v).isNotNull()
    low = F.least(*[F.col(v) for v in wanted]) if len(wanted) > 1 else F.col(wanted[0])
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("latest_month")) for v in wanted])
    return found.select(F.inline(rows), F.when(all_there, low).alias("latest_common_month"))


def missing_variables(required: list[str], available: Column) -> Column:
    """Required variables a month lacks, in the order they were required;
    precipitation needs the total or both parts."""
    parts = F.array(*[F.lit(p) for p in PRECIP_PARTS])
    have = F.coalesce(available, F.array().cast("array<string>"))
    has_parts = F.size(F.array_except(parts, have)) == 0
    precip = F.lit("total_precipitation")
    offered = F.when(has_parts, F.array_append(have, precip)).otherwise(have)
    return F.array_except(F.array(*[F.lit(v) for v in required]), offered)


def resolve_month_provider(spark: SparkSession, objects: DataFrame, start_month: str, end_month: str,
                           required: list[str], hybrid: bool = True, fallback: bool = True) -> DataFrame:
    """Who serves each month: the open bucket if it is complete, else the fallback."""
    seen = objects.where(F.col("variable").isNotNull()).groupBy(
        F.format_string("%04d-%02d", "year", "month").alias("month")).agg(
        F.collect_set("variable").alias("have"))
    spine = month_spine(spark, start_month, end_month).select("month", "start_date", "end_date")
    rows = spine.join(seen, "month", "left").withColumn("missing", missing_variables(required, F.col("have")))
    complete = F.size("missing") == 0
    if not hybrid:
        provider, reason = F.lit("cds"), F.lit("hybrid_disabled")
    else:
        provider = F.when(complete, "aws").otherwise("cds" if fallback else "aws")
        reason = F.when(complete, "all_vars_available").otherwise(
            F.concat(F.lit("missing_vars="), F.concat_ws(",", "missing")))
    return rows.select("month", "start_date", "end_date", provider.alias("provider"), reason.alias("reason"))
