"""Stream offsets, packed and random blocks, windows over byte records.

The corpus is treated as one byte stream (documents concatenated in key order, no separator)
without ever materialising it as one value: each document gets its global ``[start_off,
end_off)`` from a distributed prefix sum, and anything addressed by stream position becomes an
equi-join on ``position div chunk`` against the chunk ids a document covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PAD
from ..functions.binary import byte_lit, col_, utf8
from ..functions.rank import with_exclusive_sum
from ..functions.rng import u01


def _bytes_of(df: DataFrame, col: str):
    return utf8(col) if dict(df.dtypes)[col] == "string" else F.col(col)


def stream_offsets(df: DataFrame, key: str, col: str = "text", buckets: int | None = None) -> DataFrame:
    """``(key, n_bytes, start_off, end_off)``: where each document sits in the concatenated stream.  Only keys
    and lengths are shuffled; ``key`` must be unique (any orderable type)."""
    src = df.select(F.col(key), F.octet_length(_bytes_of(df, col)).cast("long").alias("n_bytes"))
    out = with_exclusive_sum(src, [key], F.col("n_bytes"), "start_off", buckets=buckets)
    return out.withColumn("end_off", F.col("start_off") + F.col("n_bytes")).select(key, "n_bytes", "start_off", "end_off")


def _reassemble(pieces: DataFrame, group_col: str) -> DataFrame:
    """Concatenate ``(group, lo, piece)`` rows per group in ``lo`` order -> ``(group, lo0, data)``."""
    return pieces.groupBy(group_col).agg(
        F.min("lo").alias("lo0"),
        F.aggregate(
            F.transform(F.array_sort(F.collect_list(F.struct("lo", "piece"))), lambda s: s["piece"]),
            F.unhex(F.lit("")),
            lambda acc, x: F.concat(acc, x),
        ).alias("data"),
    )


def _pieces(df: DataFrame, offs: DataFrame, key: str, col: str, span: int, stride: int) -> DataFrame:
    """Cut documents into the pieces that fall in windows ``[g*stride, g*stride + span)``: the offsets meet the
    texts in one join, and the pieces are cut in the same stage."""
    s, e = F.col("start_off"), F.col("end_off")
    g_lo = F.greatest(F.floor((s - span) / stride) + 1, F.lit(0)).cast("long")
    g_hi = F.floor((e - 1) / stride).cast("long")
    texts = df.select(F.col(key), _bytes_of(df, col).alias("bytes"))
    x = texts.join(offs.where(F.col("n_bytes") > 0), key).select(
        "start_off", "end_off", "bytes", F.explode(F.sequence(g_lo, g_hi)).alias("g")
    )
    lo = F.greatest(s, F.col("g") * stride)
    hi = F.least(e, F.col("g") * stride + span)
    return x.where(lo < hi).select(
        "g", lo.alias("lo"), F.substring(F.col("bytes"), (lo - s + 1).cast("int"), (hi - lo).cast("int")).alias("piece")
    )


def stream_blocks_packed(df: DataFrame, offs: DataFrame, key: str, col: str = "text", block: int = 1024, stride: int | None = None) -> DataFrame:
    """Every block ``x = stream[g*stride, +block)``, ``y = stream[g*stride+1, +block)`` that fits.

    Each window carries one extra byte (the next block's first) so the targets need no second join.
    """
    stride = stride or block
    span = block + 1
    win = _reassemble(_pieces(df, offs, key, col, span, stride), "g")
    # a window inside the stream has exactly `span` bytes; only tail windows are shorter
    full = win.where(F.octet_length("data") == span)
    return full.select(
        F.col("g").alias("block_id"),
        (F.col("g") * stride).alias("start_off"),
        F.substring("data", 1, block).alias("x"),
        F.substring("data", 2, block).alias("y"),
    )


def _chunks_of(offs: DataFrame, chunk: int) -> DataFrame:
    """The narrow offsets, one row per chunk ``c`` of the stream a document covers."""
    ids = F.sequence(F.floor(F.col("start_off") / chunk).cast("long"), F.floor((F.col("end_off") - 1) / chunk).cast("long"))
    return offs.where(F.col("n_bytes") > 0).withColumn("c", F.explode(ids))


def locate_ranges(df: DataFrame, offs: DataFrame, key: str, col: str, wanted: DataFrame, id_col: str, start_col: str, length: int, chunk: int) -> DataFrame:
    """Fetch ``stream[start, start+length)`` for each wanted row (``length`` <= ``chunk``).

    Wanted rows meet the narrow offsets on the (at most two) chunk ids they touch, which gives document, place and
    length of each piece; only then are the texts read, cut and regrouped.
    """
    w = wanted.select(F.col(id_col).alias("__id"), F.col(start_col).alias("__s"))
    wc = w.select("__id", "__s", F.explode(F.array_distinct(F.array(
        F.floor(F.col("__s") / chunk).cast("long"), F.floor((F.col("__s") + length - 1) / chunk).cast("long")))).alias("c"))
    j = _chunks_of(offs, chunk).join(wc, "c")
    s, e = F.col("start_off"), F.col("end_off")
    lo = F.greatest(s, F.col("__s"), F.col("c") * chunk)
    hi = F.least(e, F.col("__s") + length, (F.col("c") + 1) * chunk)
    places = j.where(lo < hi).select(key, "__id", lo.alias("lo"), (lo - s + 1).cast("int").alias("__at"), (hi - lo).cast("int").alias("__n"))
    texts = df.select(F.col(key), _bytes_of(df, col).alias("bytes"))
    pieces = texts.join(places, key).select("__id", "lo", F.substring(F.col("bytes"), F.col("__at"), F.col("__n")).alias("piece"))
    out = _reassemble(pieces, "__id")
    return out.select(F.col("__id").alias(id_col), F.col("lo0").alias(start_col), "data")


def stream_blocks_random(df: DataFrame, offs: DataFrame, key: str, col: str = "text", block: int = 1024, k: int = 2, seed: int = 42, total=None) -> DataFrame:
    """``k`` blocks at starts drawn uniformly from ``[0, L - block)``; ``y`` is the true next byte.

    ``total`` (the stream length L, a scalar column) can be supplied from a cheaper source than the
    offsets (e.g. a byte-length sum over the documents) so the offsets are derived only once.
    Fails (raises at execution) when the stream holds no more than ``block`` bytes.
    """
    spark = offs.sparkSession
    if total is None:
        total = offs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).scalar()
    starts = spark.range(k).select(
        F.col("id").alias("draw"),
        F.when(total > block, F.floor(u01(seed, F.lit("blocks"), "id") * (total - block)))
        .otherwise(F.raise_error(F.lit(f"stream must hold more than {block} bytes")))
        .cast("long")
        .alias("start_off"),
    )
    got = locate_ranges(df, offs, key, col, starts, "draw", "start_off", block + 1, block + 1)
    return got.select(
        "draw", "start_off", F.substring("data", 1, block).alias("x"), F.substring("data", 2, block).alias("y")
    )


def locate_positions(df: DataFrame, offs: DataFrame, key: str, col: str, draws: DataFrame, pos_col: str = "pos", chunk: int = 1 << 16) -> DataFrame:
    """Byte value at each stream position in ``draws`` (duplicates kept: one output row per draw)."""
    d = draws.withColumn("c", F.floor(F.col(pos_col) / chunk).cast("long"))
    s, e = F.col("start_off"), F.col("end_off")
    j = _chunks_of(offs, chunk).join(d, "c").where((F.col(pos_col) >= s) & (F.col(pos_col) < e))
    places = j.select(key, *draws.columns, (F.col(pos_col) - s + 1).cast("int").alias("__at"))
    texts = df.select(F.col(key), _bytes_of(df, col).alias("bytes"))
    return texts.join(places, key).select(
        *[F.col(c) for c in draws.columns],
        F.conv(F.hex(F.substring(F.col("bytes"), F.col("__at"), 1)), 16, 10).cast("int").alias("byte"),
    )


def window_crop_or_pad(df: DataFrame, key: str, col: str, block: int = 1024, seed: int = 42, out: str = "x") -> DataFrame:
    """Records longer than ``block`` -> random crop with start in ``[0, len-block)``; others right-padded with 0."""
    b = F.col(col)
    n = F.octet_length(b)
    start = F.floor(u01(seed, F.lit("crop"), key) * (n - block)).cast("int")
    return df.withColumn(
        out,
        F.when(n > block, F.substring(b, start + 1, block)).otherwise(F.rpad(b, block, byte_lit(PAD))),
    )


def next_byte_target(df: DataFrame, col: str = "x", out: str = "y") -> DataFrame:
    """``y = x[1:] + [0]``."""
    return df.withColumn(out, F.concat(F.expr(f"substring({col}, 2)"), byte_lit(PAD)))


def context_tail(df: DataFrame, col: str, block: int = 1024, out: str = "tail") -> DataFrame:
    """Last ``block`` bytes of the record (all of it when shorter)."""
    n = F.octet_length(col_(col))
    return df.withColumn(out, F.substring(col_(col), (F.greatest(n - block, F.lit(0)) + 1).cast("int"), block))


def batch_ids(df: DataFrame, idx_col: str = "idx", batch: int = 2, accum: int = 8) -> DataFrame:
    """Batch number and gradient-accumulation group from a dense 0-based index."""
    return df.withColumn("batch_id", F.floor(F.col(idx_col) / batch).cast("long")).withColumn(
        "accum_group", F.floor(F.col(idx_col) / (batch * accum)).cast("long")
    )
