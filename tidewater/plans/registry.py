"""Registry of bound queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewater.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its equivalent on the same tables."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(run)
        def safe(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return run(spark, folder)

        QUERIES[name] = safe
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add
