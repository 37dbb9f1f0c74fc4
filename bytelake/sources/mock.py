"""Deterministic template pairs (the reference's 500-row mock set) generated by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MOCK_PROMPT, MOCK_RESPONSE


def mock_pairs(spark: SparkSession, n: int = 500) -> DataFrame:
    """``n`` pairs: prompt numbered by row, fixed tagged response."""
    return mock_pairs_for(spark.range(n).withColumnRenamed("id", "pair_id"), "pair_id")


def mock_pairs_for(keys: DataFrame, key: str) -> DataFrame:
    """One template pair per key row (the key is the problem number)."""
    pre, post = MOCK_PROMPT.split("{i}")
    return keys.select(
        F.col(key).cast("long").alias("pair_id"),
        F.concat(F.lit(pre), F.col(key).cast("string"), F.lit(post)).alias("prompt"),
        F.lit(MOCK_RESPONSE).alias("response"),
    )
