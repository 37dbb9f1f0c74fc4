"""Binary (byte sequence) expressions.  Bytes stay ``BinaryType`` at rest (1 byte per token);
hex strings are used where a value must be compared or hashed by another engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BOS, EOS


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf8(c) -> Column:
    """Text -> UTF-8 bytes."""
    return F.encode(col_(c), "UTF-8")


def byte_lit(value: int) -> Column:
    """A one-byte binary literal."""
    return F.unhex(F.lit(f"{value:02X}"))


def bos_bin() -> Column:
    return byte_lit(BOS)


def eos_bin() -> Column:
    return byte_lit(EOS)


def nbytes(c) -> Column:
    return F.octet_length(col_(c))


def hex_pairs(c) -> Column:
    """Binary -> array<string> of two-digit hex bytes, one regex pass over ``hex(c)``."""
    return F.regexp_extract_all(F.hex(col_(c)), F.lit("(..)"), 1)


def byte_array(c) -> Column:
    """Binary -> array<int> of byte values (0..255), computed inside the row (no explode)."""
    return F.transform(hex_pairs(c), lambda x: F.conv(x, 16, 10).cast("int"))


def array_to_binary(arr) -> Column:
    """array<int> of byte values -> binary (inverse of :func:`byte_array`)."""
    return F.unhex(F.array_join(F.transform(col_(arr), lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def valid_utf8_text(c) -> Column:
    """Binary -> text where each malformed sequence becomes U+FFFD (Python ``errors='replace'``)."""
    return F.make_valid_utf8(col_(c).cast("string"))
