"""Registration of named queries: a DataFrame program and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(oracle: str | None = None):
    """Register a function of Tables under its own name."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put
