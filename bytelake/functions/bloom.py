"""A Bloom filter of a column of digests, built and asked with Spark's own bitmap functions.

The filter is a table of 4 KB bitmaps, ``2^bits / 32768`` of them whatever the input (8 MB at the default), so it may always be
broadcast.  It prunes the larger side of an exact join before that side is shuffled: a digest of the smaller side is never lost, others pass with
a probability of about ``(2 n / 2^bits)^2`` for ``n`` distinct digests in the filter.  More digests than bits only mean less pruning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26
_MAP_BITS = 15  # of one bitmap of ``bitmap_construct_agg``


def _slots(digest: Column, bits: int) -> list[Column]:
    h = F.xxhash64(digest)
    mask = F.lit((1 << bits) - 1)
    return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 64 - bits).bitwiseAND(mask)]


def bloom_filter(df: DataFrame, digest: Column, bits: int = BITS) -> DataFrame:
    """``(part, bitmap)`` rows; null digests are left out (they join nothing)."""
    if not _MAP_BITS <= bits <= 31:
        raise ValueError(f"bits must be {_MAP_BITS} to 31")
    slots = df.where(digest.isNotNull()).select(F.explode(F.array(*_slots(digest, bits))).alias("slot"))
    place = slots.select(F.shiftright("slot", _MAP_BITS).alias("part"), F.col("slot").bitwiseAND(F.lit((1 << _MAP_BITS) - 1)).alias("bit"))
    return place.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def may_contain(df: DataFrame, digest: Column, filter_rows: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows of ``df`` whose digest may be in the filter, with their own columns; no row of ``df`` is shuffled."""
    out = df.where(digest.isNotNull())
    for i, slot in enumerate(_slots(digest, bits)):
        at, part, bitmap = f"__bf_at{i}", f"__bf_part{i}", f"__bf_map{i}"
        maps = F.broadcast(filter_rows.select(F.col("part").alias(part), F.col("bitmap").alias(bitmap)))
        out = out.withColumn(at, slot)
        bit = F.col(at).bitwiseAND(F.lit((1 << _MAP_BITS) - 1))
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(bit, 3).cast("int") + 1, 1)), 16, 10).cast("int")
        is_set = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), bit.bitwiseAND(F.lit(7)).cast("int") + 1)) != 0
        out = out.join(maps, F.shiftright(F.col(at), _MAP_BITS) == F.col(part)).where(is_set).drop(at, part, bitmap)
    return out
