"""A module's registered queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake.sources.tables import table


class Tables:
    """The bundled tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self._dir, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function of the tables under its name."""

        def add(fn: Callable[[Tables], DataFrame]):
            self.queries[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql:
                self.oracles[fn.__name__] = sql
            return fn

        return add
