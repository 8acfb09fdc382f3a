"""Training-data operators for large text collections.

``queries()`` and ``oracle_sql()`` are what ``__spark_entry__.py`` registers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, ngram_join, packing, pii, pivot_search, quality, secret_scan, shards, token_store

_MODULES = (token_store, ngram_join, pivot_search, shards, packing, pii, licenses, secret_scan, decontam, quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every ``opN_<name>`` of this package's modules."""
    found = {k: f for m in _MODULES for k, f in vars(m).items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {k: m.ORACLE for m in _MODULES if hasattr(m, "ORACLE") for k in vars(m) if k.startswith("op") and k[2].isdigit()}
