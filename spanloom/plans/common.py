"""What the query modules share: tables, and a registry of a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalogue:
    """Queries by name, and the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
