"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinmap.plans import graph_queries, kernel_queries, more_queries, state_queries, table_queries

MODULES = (graph_queries, table_queries, kernel_queries, more_queries, state_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.S.items()}
