"""Byte tokenization, decoding, audits and special-token handling, as native column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ANSWER_END_TAG, BOS, DECODE_ERROR_MESSAGE, EOS, PAD, THINK_END_TAG
from ..functions.binary import byte_array, col_, hex_pairs, utf8


def utf8_bytes(df: DataFrame, col: str = "text", out: str = "bytes") -> DataFrame:
    """Text column -> UTF-8 binary column (one byte per token)."""
    return df.withColumn(out, utf8(col))


def token_table(df: DataFrame, id_col: str, bin_col: str = "bytes") -> DataFrame:
    """Long form ``(id, pos, byte)``: one row per token (use only where per-token rows are needed).

    Positions are generated rows and each byte is read with a binary ``substring`` (whole-stage
    codegen), not an exploded array.
    """
    n = F.octet_length(bin_col)
    x = df.where(n > 0).select(F.col(id_col).alias("id"), F.col(bin_col).alias("__b"), F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return x.select("id", "pos", F.conv(F.hex(F.substring("__b", F.col("pos") + 1, 1)), 16, 10).cast("int").alias("byte"))


def decode_replace(df: DataFrame, col: str = "bytes", out: str = "text") -> DataFrame:
    """Binary -> valid text (each malformed sequence -> U+FFFD) plus a ``repaired`` flag."""
    s = F.col(col).cast("string")
    return df.withColumn(out, F.make_valid_utf8(s)).withColumn("repaired", ~F.is_valid_utf8(s))


def decode_strict_or_message(df: DataFrame, col: str = "bytes", out: str = "text", message: str = DECODE_ERROR_MESSAGE) -> DataFrame:
    """Valid UTF-8 rows decode as is; undecodable rows get the fixed message (``decoded`` flag false)."""
    v = F.try_validate_utf8(F.col(col).cast("string"))
    return df.withColumn("decoded", v.isNotNull()).withColumn(out, F.coalesce(v, F.lit(message)))


def encoding_audit(df: DataFrame, col: str = "text", group=("lang",)) -> DataFrame:
    """Per group: rows, characters, bytes, multi-byte share of bytes, rows with multi-byte text, invalid rows."""
    t = F.col(col)
    chars, nbytes = F.sum(F.char_length(t)), F.sum(F.octet_length(t))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        chars.cast("long").alias("n_chars"),
        nbytes.cast("long").alias("n_bytes"),
        F.count_if(F.octet_length(t) > F.char_length(t)).alias("n_multibyte_rows"),
        F.round(F.lit(1.0) - chars / nbytes, 6).alias("multibyte_share"),
        F.count_if(~F.is_valid_utf8(t)).alias("n_invalid"),
    )


def corpus_byte_totals(df: DataFrame, col: str = "text", split_col: str = "split") -> DataFrame:
    """UTF-8 bytes per split (a null split stays null) plus a ``total`` row (rollup)."""
    return df.rollup(split_col).agg(F.sum(F.octet_length(col)).cast("long").alias("n_bytes"), F.grouping(split_col).alias("__all")).select(
        F.when(F.col("__all") == 1, "total").otherwise(F.col(split_col)).alias(split_col), "n_bytes"
    )


def padding_mask_stats(df: DataFrame, col: str = "y", out: str = "n_valid") -> DataFrame:
    """Number of target bytes that count in the loss (target != 0, so real NUL bytes are masked too)."""
    return df.withColumn(out, F.size(F.filter(hex_pairs(col), lambda x: x != F.lit(f"{PAD:02X}"))))


def strip_special(df: DataFrame, col: str = "bytes", out: str | None = None) -> DataFrame:
    """Drop every BOS byte, then cut at the first EOS byte."""
    kept = F.filter(hex_pairs(col), lambda x: x != F.lit(f"{BOS:02X}"))
    cut = F.array_position(kept, f"{EOS:02X}")
    arr = F.when(cut > 0, F.slice(kept, F.lit(1), (cut - 1).cast("int"))).otherwise(kept)
    return df.withColumn(out or col, F.unhex(F.array_join(arr, "")))


STOP_WINDOW = 30  # the answer tag must lie within this many last bytes


def _first_stop(context: bytes, generated: bytes, limit: int) -> tuple[str, int]:
    """``(reason, kept bytes)`` of a finished byte generation (see :func:`stop_reason`)."""
    c, n = len(context), min(len(generated), limit)
    eos = generated.find(bytes([EOS]), 0, n) + 1
    best = ("eos", eos) if eos else ("max_length", n) if n == limit else ("complete", n)
    raw = context + generated[:n]
    at = [i for i, b in enumerate(raw) if b] if 0 in raw else range(len(raw))  # zero bytes don't count as text
    text = bytes(raw[i] for i in at) if 0 in raw else raw
    think = text.find(THINK_END_TAG.encode())
    tag = ANSWER_END_TAG.encode()
    found = text.find(tag) if think >= 0 else -1
    while found >= 0:
        start, end = at[found], at[found + len(tag) - 1]
        stop = max(1, end - c + 1, at[think + len(THINK_END_TAG) - 1] - c + 1)
        if stop <= n and start >= c + stop - STOP_WINDOW:
            if stop < best[1] or stop == best[1] and best[0] != "eos":
                best = ("answer_end", stop)
            break
        found = text.find(tag, found + 1)
    return best


def stop_reason(df: DataFrame, completion: str = "completion", ref_len: str = "ref_len", context: str | None = None, cap: int = 4096) -> DataFrame:
    """Where generation would have stopped in a finished completion (text or bytes), and why.

    The least of: the first EOS byte (inclusive); the first position whose last 30 bytes of context and output, without zero
    bytes, hold ``</answer>`` while ``</think>`` has occurred in context or output; the length limit
    ``min(cap, 2 * ref_len)``.  ``complete`` when none applies.
    """
    kinds = dict(df.dtypes)
    gen = F.col(completion) if kinds[completion] == "binary" else utf8(completion)
    ctx = F.unhex(F.lit("")) if context is None else (F.col(context) if kinds[context] == "binary" else utf8(context))

    @F.pandas_udf("stop_reason string, stop_len long")
    def stops(c: pd.Series, g: pd.Series, limit: pd.Series) -> pd.DataFrame:
        rows = [_first_stop(bytes(a or b""), bytes(b or b""), int(n)) for a, b, n in zip(c, g, limit, strict=True)]
        return pd.DataFrame(rows, columns=["stop_reason", "stop_len"])

    limit = F.least(F.lit(cap), 2 * F.coalesce(F.col(ref_len), F.lit(0))).cast("long")
    return df.withColumn("__stop", stops(ctx, gen, limit)).select("*", "__stop.*").drop("__stop")
