"""All queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill import suite
from tracemill.plans.lens import Lens
from tracemill.suite import analyses, catalog, evaluation, exchange, judging, more  # noqa: F401  they register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.flagship(Lens(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: suite.runner(name) for name in suite.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(suite.ORACLES)
