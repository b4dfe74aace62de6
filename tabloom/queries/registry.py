"""Registration of queries and small helpers shared by their definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Set by the bench, whose tables are single files of one row group and so single tasks: spread heavy work over the cores first.
spread_tables = False

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def read_table(spark: SparkSession, path: str, spread: bool) -> DataFrame:
    """A given table, as it is laid out unless ``spread_tables`` asks for more."""
    df = spark.read.parquet(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if spread and spread_tables else df


def query(name: str, sql: str | None = None, spread: bool = False):
    """Register ``fn(table) -> DataFrame`` where ``table(name)`` reads one of the given tables."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: read_table(spark, f"{sf_dir}/{table}.parquet", spread))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (run, sql)
        return fn

    return register
