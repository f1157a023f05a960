"""Queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUILDS: dict[str, Callable] = {}


def query(name: str, build: Callable, oracle: str | None) -> None:
    """Registers build(fixtures) under a name; without an oracle the result is covered by tests only."""
    from wallscan.plans.fixtures import Fixtures

    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    BUILDS[name] = build
    QUERIES[name] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
    if oracle:
        ORACLES[name] = oracle


def load() -> None:
    """Imports the modules that register queries."""
    from wallscan.plans import cloud_queries, profile_queries, voxel_queries  # noqa: F401
