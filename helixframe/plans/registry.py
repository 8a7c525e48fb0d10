"""Collects the named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import duckdb_sql, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register build(v) under name; v(view) gives a fixture view or a driver table."""

    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(lambda view_name: view(spark, sf_dir, view_name))
        if oracle:
            ORACLES[name] = duckdb_sql(oracle)
        return build

    return register
