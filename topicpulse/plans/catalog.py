"""Registered queries: name -> (spark callable, equivalent DuckDB SQL or None).

Each callable takes ``(spark, base_dir)``, reads the test tables under ``base_dir``
through the adapters in ``sources.testdata`` and returns a DataFrame. The SQL is
an independent formulation over the same tables, used as the correctness oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries (idempotent)."""
    from . import q_batch, q_text, q_ingest, q_views  # noqa: F401
