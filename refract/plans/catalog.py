"""Registry of named queries: ``name -> (spark_fn(spark, sf_dir), oracle_sql)``.

Every query reads the driver tables (whole tables) and is expressed with the
library's operators; the oracle SQL restates it for DuckDB over the same
parquet views.  Queries without SQL are checked by row count plus their own
tests (brute force on small inputs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (they register on import)."""
    from refract.plans import (q_sources, q_text, q_generate, q_index,  # noqa: F401
                               q_retrieval, q_eval)
