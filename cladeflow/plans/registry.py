"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixture, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a Fixture under a name, with the SQL for the same rows."""

    def register(make: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: make(Fixture(spark, sf_dir))
        if sql is not None:
            SQL[name] = oracle(sql)
        return make

    return register
