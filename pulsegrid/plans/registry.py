"""Registered queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.plans import graph_queries, kept_queries, more_queries, trend_queries

Query = Callable[[SparkSession, str], DataFrame]
ALL = trend_queries.QUERIES | graph_queries.QUERIES | more_queries.QUERIES | kept_queries.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
