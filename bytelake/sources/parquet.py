"""Parquet corpus and pair sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONTENT_COLUMN_NAMES


def scan_corpus_glob(spark: SparkSession, path_glob: str, columns: list[str] | None = None) -> DataFrame:
    """Read many parquet parts as one table; ``columns`` prunes the scan."""
    df = spark.read.parquet(path_glob)
    return df.select(*columns) if columns else df


def detect_content_column(df: DataFrame, names=CONTENT_COLUMN_NAMES) -> str:
    """First column whose lower-case name is one of ``names``; else the first column (schema only)."""
    for c in df.columns:
        if c.lower() in names:
            return c
    return df.columns[0]


def select_content(df: DataFrame, key: str | None = None, names=CONTENT_COLUMN_NAMES, out: str = "text") -> DataFrame:
    """Project the detected content column (and the key) only, so the scan reads nothing else."""
    c = detect_content_column(df, names)
    cols = ([F.col(key)] if key else []) + [F.col(c).alias(out)]
    return df.select(*cols)


def scan_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Read a prompt/response table (columns ``prompt``, ``response``; ``pair_id`` if present)."""
    df = spark.read.parquet(path)
    cols = [c for c in ("pair_id", "prompt", "response") if c in df.columns]
    if "prompt" not in cols or "response" not in cols:
        raise ValueError(f"{path}: needs prompt and response columns, has {df.columns}")
    return df.select(*cols)


def source_fallback(spark: SparkSession, paths: list[str], reader=None) -> DataFrame:
    """First source in ``paths`` that resolves (schema read), error if none does."""
    reader = reader or (lambda p: spark.read.parquet(p))
    errors = []
    for p in paths:
        try:
            df = reader(p)
            df.schema  # force resolution
            return df
        except AnalysisException as e:  # missing path, unreadable schema
            errors.append(f"{p}: {e.getCondition() if hasattr(e, 'getCondition') else e}")
    raise FileNotFoundError("no readable source among: " + "; ".join(errors))


def corpus_profile(df: DataFrame) -> DataFrame:
    """One row: total rows and null count per column (a single aggregation pass)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in df.columns]
    return df.agg(*aggs)


def head_sample(df: DataFrame, order_col: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows in key order (source order is not stable in Spark)."""
    return df.orderBy(order_col).limit(n)
