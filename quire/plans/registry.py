"""Queries and their SQL by name; modules of this folder add theirs with the decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def spread(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table whose rows take long each, dealt out by its first column: small files are read by one or two tasks, however many rows they hold."""
    return read(spark, sf_dir, table, *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), columns[0])
