"""Feature statistics on embedding vectors: layer-normalised moments, EMA moments, threshold gate.

Vectors stay in-row (array transforms); only per-dimension sums are aggregated, so nothing is
exploded and regrouped per vector.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import with_row_index


def layer_norm(df: DataFrame, col: str = "embedding", out: str = "xn", eps: float = 1e-5) -> DataFrame:
    """Per-vector ``(x - mean) / sqrt(var_pop + eps)`` (no affine part).

    The per-vector statistics enter the element-wise step through ``array_repeat`` (evaluated once
    per row), so no lambda re-evaluates a whole-vector aggregate per element.
    """
    x = df.withColumn("__x", F.transform(F.col(col), lambda v: v.cast("double")))
    n = F.size("__x")
    s1 = F.aggregate("__x", F.lit(0.0), lambda a, v: a + v)
    x = x.withColumn("__m", s1 / n)
    centered = F.zip_with("__x", F.array_repeat(F.col("__m"), n), lambda v, m: v - m)
    x = x.withColumn("__c", centered)
    var = F.aggregate("__c", F.lit(0.0), lambda a, v: a + v * v) / F.size("__c")
    inv = F.lit(1.0) / F.sqrt(var + F.lit(eps))
    x = x.withColumn(out, F.zip_with("__c", F.array_repeat(inv, F.size("__c")), lambda v, k: v * k))
    return x.drop("__x", "__m", "__c")


def _dim_sums(df: DataFrame, col: str, group=()) -> DataFrame:
    """Per (group, dim): n, sum, sum of squares — one posexplode of the normalised vectors."""
    e = df.select(*group, F.posexplode(col).alias("dim", "v"))
    return e.groupBy(*group, "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))


def dim_moments(emb: DataFrame, col: str = "embedding", eps: float = 1e-5) -> DataFrame:
    """Mean and population variance per dimension of the layer-normalised vectors."""
    s = _dim_sums(layer_norm(emb, col, "xn", eps), "xn")
    mean = F.col("s") / F.col("n")
    return s.select("dim", mean.alias("mean"), (F.col("ss") / F.col("n") - mean * mean).alias("var"))


def ema_moments(emb: DataFrame, key: str = "vec_id", col: str = "embedding", batch: int = 32, momentum: float = 0.01, eps: float = 1e-5) -> DataFrame:
    """Running mean/var after one pass of batches in key order (start 0 / 1), in closed form:
    ``r_B = (1-m)^B * r_0 + sum_b m * (1-m)^(B-1-b) * stat_b`` — no sequential loop."""
    x = with_row_index(layer_norm(emb, col, "xn", eps), [key], "__i")
    x = x.withColumn("__b", F.floor(F.col("__i") / batch).cast("long"))
    s = _dim_sums(x, "xn", ["__b"])
    m = F.col("s") / F.col("n")
    s = s.select("__b", "dim", m.alias("bm"), (F.col("ss") / F.col("n") - m * m).alias("bv"))
    nb = x.agg(F.max("__b") + 1).scalar()
    decay = 1.0 - momentum
    wgt = F.lit(momentum) * F.pow(F.lit(decay), nb - 1 - F.col("__b"))
    out = s.groupBy("dim").agg(F.sum(wgt * F.col("bm")).alias("__sm"), F.sum(wgt * F.col("bv")).alias("__sv"))
    keep = F.pow(F.lit(decay), nb)
    return out.select("dim", (keep * 0.0 + F.col("__sm")).alias("running_mean"), (keep * 1.0 + F.col("__sv")).alias("running_var"))


def threshold_gate(emb: DataFrame, moments: DataFrame, col: str = "embedding", var_col: str = "running_var", threshold_param: float = 0.5, eps: float = 1e-5, out: str = "gated") -> DataFrame:
    """``theta = sigmoid(a) * sqrt(max(var, 1e-6))``, ``gate = sigmoid(|xn| - theta)``,
    ``out = clamp(alpha * gate * x + (1 - alpha) * x, -100, 100)`` with ``alpha = sigmoid(a)``.

    The per-dimension thresholds (one value per dimension) arrive as one array via a scalar subquery.
    """
    alpha = 1.0 / (1.0 + math.exp(-threshold_param))
    theta = moments.select(
        F.sort_array(F.collect_list(F.struct("dim", (F.lit(alpha) * F.sqrt(F.greatest(F.col(var_col), F.lit(1e-6)))).alias("t")))).alias("th")
    ).scalar()
    x = layer_norm(emb, col, "__xn", eps).withColumn("__th", theta)
    x = x.withColumn("__x", F.transform(F.col(col), lambda v: v.cast("double")))
    gated = F.zip_with(
        "__x",
        "__xn",
        lambda v, n: F.struct(v.alias("v"), n.alias("n")),
    )
    res = F.transform(
        gated,
        lambda p, i: F.greatest(
            F.lit(-100.0),
            F.least(
                F.lit(100.0),
                F.lit(alpha) * (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.abs(p["n"]) - F.element_at(F.col("__th"), i + 1)["t"])))) * p["v"]
                + F.lit(1.0 - alpha) * p["v"],
            ),
        ),
    )
    return x.withColumn(out, res).drop("__xn", "__th", "__x")
