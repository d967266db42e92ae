"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.sources.tables import load, register

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in Spark SQL; ``oracle`` is its text for the other engine where that differs."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        register(spark, folder, text)
        return spark.sql(text)

    QUERIES[name] = run
    SQL[name] = text if oracle is None else oracle


def frame(name: str, oracle: str | None = None):
    """Decorator for a query built of DataFrame operators; it gets a function that loads tables, and the session."""

    def wrap(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(lambda table: load(spark, folder, table), spark)

        QUERIES[name] = run
        if oracle is not None:
            SQL[name] = oracle
        return build

    return wrap
