"""All queries and their SQL twins."""

from __future__ import annotations

from . import climate, fires, ledgers, portfolio, provinces, streams
from .views import Tables, duck_sql

MODULES = [climate, portfolio, fires, provinces, ledgers, streams]


def queries() -> dict:
    out = {}
    for module in MODULES:
        for name, build in module.QUERIES.items():
            out[name] = lambda spark, sf_dir, b=build: b(Tables(spark, sf_dir))
    return out


def oracle_sql() -> dict[str, str]:
    return {name: duck_sql(sql) for module in MODULES for name, sql in module.ORACLES.items()}
