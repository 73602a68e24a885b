"""Named queries over the supplied tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

DOMAINS = ("flows", "associations", "parameters", "rules", "anomalies", "gateway", "fleet", "ledger", "exports", "corpus", "analysis", "learn", "live", "decode")


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def load() -> None:
    for domain in DOMAINS:
        import_module(f"culvert.catalog.{domain}")
