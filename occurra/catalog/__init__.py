"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from occurra.catalog import curation, exchange, functions, graph, requests, search
from occurra.catalog.registry import REGISTRY
from occurra.sources.star import duckdb_sql

MODULES = (functions, graph, search, exchange, requests, curation)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {
        name: duckdb_sql(entry.sql, entry.ctes) for name, entry in REGISTRY.items() if entry.sql is not None
    }
