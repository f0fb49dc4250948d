"""Registers queries with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (tables, spark, sf_dir) under its name; tables(name) reads a table."""

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda t: table(spark, sf_dir, t), spark)

        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return register
