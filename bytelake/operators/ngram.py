"""Counted next-byte model: ``(ctx, next)`` counts, smoothed probabilities, softmax.

It stands in for the neural next-byte model so losses, KL and top-p have a real input.  Counting
happens per task on Arrow buffers (map-side combine), so only distinct ``(group, ctx, next)``
codes per task are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import VOCAB
from ..functions.arrow_counts import ngram_blocks, value_bytes


def _count_task(k: int, grouped: bool):
    if not 1 <= k <= 6:
        raise ValueError("contexts of 1 to 6 bytes fit a 63-bit code")
    width = 8 * (k + 1)  # bits of one (ctx, next) code
    dense = not grouped and width <= 16  # k = 1: a 65,536-bin count vector per task

    def fn(it):
        if dense:
            acc = np.zeros(1 << width, np.int64)
            for batch in it:
                for codes, _ in ngram_blocks(*value_bytes(batch.column(0)), k):
                    acc += np.bincount(codes, minlength=1 << width)
            nz = np.nonzero(acc)[0]
            if len(nz):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(nz), np.int64)), pa.array(nz.astype(np.int64)), pa.array(acc[nz])],
                    names=["grp", "code", "cnt"],
                )
            return
        # a partial table per block of positions; the groupBy merges them, so a task holds one block at a time
        for batch in it:
            groups = batch.column(1).to_numpy(zero_copy_only=False) if grouped else None
            for codes, owner in ngram_blocks(*value_bytes(batch.column(0)), k, with_owner=True):
                if not len(codes):
                    continue
                g = groups[owner].astype(np.int64) if grouped else np.zeros(len(codes), np.int64)
                if width < 63 and g.min() >= 0 and g.max() < (1 << (63 - width)):
                    key, cnt = np.unique((g << width) | codes, return_counts=True)
                    out = [key >> width, key & ((1 << width) - 1), cnt]
                else:
                    pairs, cnt = np.unique(np.stack([g, codes], 1), axis=0, return_counts=True)
                    out = [pairs[:, 0], pairs[:, 1], cnt]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], names=["grp", "code", "cnt"])

    return fn


def _ctx_hex(code_col, k: int):
    return F.lpad(F.hex(F.shiftright(code_col, 8)), 2 * k, "0")


def ngram_counts(df: DataFrame, col: str = "text", k: int = 1, group_col: str | None = None) -> DataFrame:
    """Counts of (previous ``k`` bytes -> next byte) inside each value of ``col``.

    Output ``(ctx, next, cnt)`` (plus ``group_col`` when given); ``ctx`` is the hex of the k context bytes.
    """
    cols = [F.col(col)] + ([F.col(group_col).cast("long")] if group_col else [])
    part = df.select(*cols).mapInArrow(_count_task(k, group_col is not None), "grp long, code long, cnt long")
    keys = ["grp", "code"] if group_col else ["code"]
    agg = part.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))
    out = [F.col("grp").alias(group_col)] if group_col else []
    return agg.select(
        *out,
        _ctx_hex(F.col("code"), k).alias("ctx"),
        F.col("code").bitwiseAND(255).cast("int").alias("next"),
        F.col("cnt").cast("long").alias("cnt"),
    )


def ngram_probs(counts: DataFrame, lam: float = 1.0, dense: bool = True) -> DataFrame:
    """Add-``lam`` smoothed ``P(next | ctx)``; ``dense`` expands every seen ctx to all 256 next bytes.

    One aggregation per context (a context holds at most 256 next bytes, so the collected map is
    bounded), then an in-row expansion to the 256 next bytes: the counts are read once.
    """
    per = counts.groupBy("ctx").agg(
        F.map_from_entries(F.collect_list(F.struct("next", "cnt"))).alias("__m"), F.sum("cnt").alias("ctx_total")
    )
    denom = F.col("ctx_total") + F.lit(float(VOCAB * lam))
    if dense:
        base = per.select("ctx", "ctx_total", "__m", F.explode(F.sequence(F.lit(0), F.lit(VOCAB - 1))).alias("next"))
        base = base.withColumn("cnt", F.coalesce(F.try_element_at(F.col("__m"), F.col("next")), F.lit(0)).cast("long"))
    else:
        base = per.select("ctx", "ctx_total", F.explode("__m").alias("next", "cnt"))
    return base.select("ctx", "next", "cnt", ((F.col("cnt") + F.lit(float(lam))) / denom).alias("prob"))


def softmax_rows(logits: DataFrame, group: str = "ctx", logit: str = "logit") -> DataFrame:
    """Softmax and log-softmax per group, shifted by the group max.

    The per-group max and normaliser come from aggregations joined back, so a large group is
    never ordered or buffered in one task.
    """
    mx = logits.groupBy(group).agg(F.max(logit).alias("__mx"))
    x = logits.join(mx, group).withColumn("__z", F.col(logit) - F.col("__mx"))
    norm = x.groupBy(group).agg(F.log(F.sum(F.exp("__z"))).alias("__lse"))
    return (
        x.join(norm, group)
        .withColumn("logp", F.col("__z") - F.col("__lse"))
        .withColumn("prob", F.exp("logp"))
        .drop("__mx", "__z", "__lse")
    )
