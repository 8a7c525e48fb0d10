"""The named queries of the library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import calls, chains, circ, extend, intervals, pipeline, reads, seeds, spans
from .plans.registry import ORACLES, QUERIES

MODULES = [calls, chains, circ, extend, intervals, pipeline, reads, seeds, spans]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
