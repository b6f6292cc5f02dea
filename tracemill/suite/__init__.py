"""Queries over the canonical tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.plans.lens import Lens, with_tables

QUERIES: dict[str, Callable[[Lens], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = "") -> Callable:
    """Register a query of a Lens; ``tables`` are the lens's tables that its SQL names."""

    def add(f: Callable[[Lens], DataFrame]) -> Callable[[Lens], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_tables(tables, sql) if tables else sql
        return f

    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](Lens(spark, sf_dir))

    run.__name__ = name
    return run
