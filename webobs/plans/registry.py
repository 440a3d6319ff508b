"""The table of queries: name -> function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, d: str):
        self._spark, self._d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._d}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers f(t: Tables) -> DataFrame under its name, or the one given."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(Tables(spark, d))

        key = run.__name__ = name or f.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return add
