"""Registered queries: one per operator of the survey inventory.

Each query is ``fn(spark, sf_dir) -> DataFrame`` reading the driver tables (or
data Spark derives from them).  ``SQL`` holds the DuckDB restatement used as the
correctness oracle; queries without one get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def r6(col):
    """Present a computed double at 6 decimals (both engines round the same way)."""
    return F.round(col, 6)


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib

    for mod in MODULES:
        importlib.import_module(f"{__package__}.{mod}")


MODULES = [
    "q_features",
    "q_clean",
    "q_sources",
    "q_joins",
    "q_present",
    "q_eda",
    "q_metrics",
    "q_models",
    "q_streaming",
]
