"""Registry of driver queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}


def query(name: str, rows: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``rows`` names the inventory rows the query exercises; without ``sql`` the
    driver only counts rows.
    """
    def wrap(fn):
        from .adapters import Tables

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        ROWS[name] = rows
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap
