"""Registry of the queries the driver runs, each with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import Tables, with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, uses: str = "", recursive: bool = False):
    """Register ``fn(tables)`` under ``name``; ``uses`` lists the derived tables the SQL refers to."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(uses.split(), sql, recursive)
        return fn

    return wrap


def rnd(expr: str, digits: int) -> str:
    """DuckDB rounding through a decimal, i.e. HALF_UP on the decimal reading of a double."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,12)), {digits}) AS DOUBLE)"
