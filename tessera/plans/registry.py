"""Registry of named queries: a Spark builder ``(spark, sf_dir) ->
DataFrame`` and, where the semantics are SQL-expressible, the equivalent
DuckDB SQL over the same tables (views named like the Parquet files)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def load_all() -> None:
    """Import every binding module (each registers its queries)."""
    from . import q_catalog, q_governance, q_ingest, q_inputs, q_memory, q_stores, q_turns, q_web  # noqa: F401
