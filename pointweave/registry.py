"""All queries of the library by name, and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("timing", "points", "neighbors", "telemetry", "sequences", "streams")


def _loaded():
    return [importlib.import_module(f"pointweave.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of the session and a table folder."""
    return {name: f for m in _loaded() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL over the same tables."""
    return {name: sql for m in _loaded() for name, sql in m.ORACLES.items()}
