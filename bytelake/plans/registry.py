"""Query registry: ``key -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage, shared_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_scratch(spark: SparkSession) -> str:
    """The session's shared folder."""
    return shared_dir(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Write a derived frame once, for plans that read it from several branches."""
    return cut_lineage(df)
