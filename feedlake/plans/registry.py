"""Query registry: every named query with its Spark plan and its DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables.  The oracle is ANSI SQL
that DuckDB runs on the same Parquet files (tables pre-registered as views); ``None`` marks
queries whose result is only checked by row count.  Column names and types agree on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    covers: str


_REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None, covers: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, oracle.strip() if oracle else None, covers)
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    # importing the catalogue modules fills the registry
    from feedlake.plans import catalog  # noqa: F401

    return dict(_REGISTRY)
