"""Filters, projections and limits on text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import PLACEHOLDER_TEXT

# Python's str.strip() whitespace: Unicode White_Space plus the four separators U+001C..U+001F
BLANK_PATTERN = r"(?U)^[\s\x1c-\x1f]*$"


def drop_null_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.na.drop(subset=[col])


def is_blank(col: str):
    return F.col(col).rlike(BLANK_PATTERN)


def drop_blank_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Remove null and whitespace-only values (Python ``strip() == ''`` semantics)."""
    return df.where(~is_blank(col))


def string_guard(df: DataFrame, col: str = "text") -> DataFrame:
    """Keep non-null strings; a non-string column keeps no rows."""
    if not isinstance(df.schema[col].dataType, StringType):
        return df.where(F.lit(False))
    return df.where(F.col(col).isNotNull())


def placeholder_if_empty(df: DataFrame, col: str = "text", text: str = PLACEHOLDER_TEXT) -> DataFrame:
    """``df`` unchanged, or one placeholder row (other columns null) when ``df`` has no rows."""
    n = df.agg(F.count(F.lit(1))).scalar()
    ph = df.sparkSession.range(1).select(
        *[(F.lit(text) if c == col else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes]
    )
    return df.unionByName(ph.where(n == 0))


def take_prefix(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """First ``n`` rows in ``order_col`` order (top-k: each task keeps n rows, then one merge)."""
    return df.orderBy(order_col).limit(n)


def preview(df: DataFrame, col: str, n: int = 100, out: str | None = None) -> DataFrame:
    """First ``n`` characters (code points) of ``col``."""
    return df.withColumn(out or col, F.substring(F.col(col), 1, n))
