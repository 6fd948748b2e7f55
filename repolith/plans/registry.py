"""All registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

CATALOGS = ["catalog_scan", "catalog_text", "catalog_code", "catalog_graph", "catalog_docs", "catalog_signals", "catalog_trace", "catalog_reports"]


def _entries() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in CATALOGS:
        found.update(import_module(f"repolith.plans.{name}").QUERIES)
    return found


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
