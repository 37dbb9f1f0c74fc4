"""Token statistics: byte histogram, frequencies, weights, audits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import VOCAB, WeightConfig
from ..functions.arrow_counts import count_bytes, value_bytes
from ..functions.binary import col_, utf8
from ..functions.rng import u01


def _hist_task(it):
    counts = np.zeros(VOCAB, np.int64)
    for batch in it:
        data, _ = value_bytes(batch.column(0))
        counts += count_bytes(data)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(VOCAB, dtype=np.int32)), pa.array(counts)], names=["byte", "cnt"]
    )


def byte_histogram(df: DataFrame, col: str = "text") -> DataFrame:
    """Count of each byte value 0..255 over the UTF-8 bytes of ``col`` (string or binary), zeros kept.

    Each task counts its Arrow batches into one 256-entry vector (map-side combine); only
    256 rows per task are shuffled to the final ``groupBy(byte).sum``.
    """
    part = df.select(F.col(col)).mapInArrow(_hist_task, "byte int, cnt long")
    agg = part.groupBy("byte").agg(F.sum("cnt").alias("cnt"))
    ids = df.sparkSession.range(VOCAB).select(F.col("id").cast("int").alias("byte"))
    return ids.join(F.broadcast(agg), "byte", "left").select(
        "byte", F.coalesce(F.col("cnt"), F.lit(0)).cast("long").alias("cnt")
    )


def byte_histogram_sampled(df: DataFrame, key: str, col: str = "text", draws: int = 1_000_000, seed: int = 42) -> DataFrame:
    """Histogram over ``draws`` byte positions drawn with replacement from the concatenated stream (all zero
    for an empty stream).  Draws are located in the stream through :func:`bytelake.operators.blocks.locate_positions`.
    """
    from .blocks import locate_positions, stream_offsets

    offs = stream_offsets(df, key, col)
    total = df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0))).scalar()
    spark = df.sparkSession
    drawn = spark.range(draws).select(
        F.col("id").alias("draw"), F.floor(u01(seed, F.lit("histogram"), "id") * total).cast("long").alias("pos")
    )
    sampled = locate_positions(df, offs, key, col, drawn, "pos").groupBy("byte").agg(F.count(F.lit(1)).alias("cnt"))
    ids = spark.range(VOCAB).select(F.col("id").cast("int").alias("byte"))
    return ids.join(F.broadcast(sampled), "byte", "left").select("byte", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def token_frequencies(hist: DataFrame, min_freq: float = WeightConfig.min_freq) -> DataFrame:
    """``cnt / total`` (uniform 1/256 when empty), clamped below at ``min_freq``, not renormalised."""
    w = Window.partitionBy()  # 256-row table: one small task
    total = F.sum("cnt").over(w)
    f = F.when(total > 0, F.col("cnt") / total).otherwise(F.lit(1.0 / VOCAB))
    return hist.withColumn("freq", F.greatest(f, F.lit(float(min_freq))))


def token_weights(freq: DataFrame, alpha: float = WeightConfig.alpha, max_weight: float = WeightConfig.max_weight) -> DataFrame:
    """``(1/f)^alpha``, capped at ``max_weight``, then scaled so the 256 weights average 1."""
    raw = F.least(F.pow(F.lit(1.0) / F.col("freq"), F.lit(float(alpha))), F.lit(float(max_weight)))
    w = Window.partitionBy()
    tmp = freq.withColumn("__w", raw)
    s = F.sum("__w").over(w)
    return tmp.withColumn("weight", F.when(s > 0, F.col("__w") * F.lit(float(VOCAB)) / s).otherwise(F.col("__w"))).drop("__w")


def max_frequency(freq: DataFrame) -> DataFrame:
    """Most common byte (smallest byte on ties) and its share."""
    return freq.agg(
        F.min_by("byte", F.struct(-F.col("freq"), F.col("byte"))).alias("top_byte"),
        F.max("freq").alias("top_freq"),
    )


def special_token_audit(df: DataFrame, col: str = "text", group: str = "lang") -> DataFrame:
    """Documents whose text already holds what the record formats use as markers.

    In valid UTF-8 the byte pairs C3BE / C3BF only occur as the characters U+00FE / U+00FF (the
    character-form BOS/EOS), and a NUL byte only as U+0000 (the pad/mask value); raw FE/FF bytes
    only occur in invalid UTF-8.
    """
    t = F.col(col)
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.instr(t, chr(254)) > 0).alias("n_bos_char"),
        F.count_if(F.instr(t, chr(255)) > 0).alias("n_eos_char"),
        F.count_if(F.instr(t, chr(0)) > 0).alias("n_nul"),
        F.count_if(~F.is_valid_utf8(t)).alias("n_invalid_utf8"),
    )
