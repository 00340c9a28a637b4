"""Registered queries: one per operator of the inventory, each with its DuckDB twin.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's parquet tables;
its oracle is SQL over the same tables registered as views. Queries without an
SQL twin (model fits) are checked by row counts and by invariant tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from equipoise.plans import (  # noqa: F401
        q_balance,
        q_models,
        q_quality,
        q_scores,
        q_sources,
        q_transforms,
    )
