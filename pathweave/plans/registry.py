"""Registry of named queries: a Spark builder and, when SQL can express it,
the DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_core, q_dataset, q_metrics, q_model, q_scalars, q_series, q_similarity, q_sources, q_stream, q_train, q_trees, q_trees_cs  # noqa: F401
