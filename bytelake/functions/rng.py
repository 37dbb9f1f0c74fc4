"""Keyed uniform randomness: ``u01(seed, key)`` in [0, 1).

The value is the first 52 bits of ``md5("<seed>:<key>")`` divided by 2^52, so it depends only on
the row key (never on partitioning or task order) and is exactly reproducible in other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2**52)


def _key_string(seed, keys) -> Column:
    parts = [F.lit(str(seed))]
    for k in keys:
        parts.append(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"))
    return F.concat_ws(":", *parts)


def u01(seed, *keys) -> Column:
    """Deterministic uniform draw in [0, 1) keyed on ``seed`` and the given columns."""
    h = F.md5(_key_string(seed, keys))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO_POW_52)


def u01_sql(seed, *key_exprs: str) -> str:
    """DuckDB twin of :func:`u01`; ``key_exprs`` are SQL expressions."""
    s = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_exprs])
    return f"(CAST(('0x' || substr(md5({s}), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0)"


def randint(seed, upper: Column, *keys) -> Column:
    """Integer in ``[0, upper)`` (``upper`` > 0), like ``randint(0, upper)`` with exclusive bound."""
    return F.floor(u01(seed, *keys) * upper).cast("long")
