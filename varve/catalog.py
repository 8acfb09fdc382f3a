"""The engine's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from inspect import isfunction

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as _queries
from .plans.sql import SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query of the engine itself."""
    return {k: f for k, f in vars(_queries).items() if isfunction(f) and f.__module__ == _queries.__name__ and not k.startswith("_")}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of each that SQL can express."""
    return dict(SQL)
