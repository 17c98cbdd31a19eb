"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platterlake.shipping import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register a query under its function's name, with the SQL that checks it."""

        def keep(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep
