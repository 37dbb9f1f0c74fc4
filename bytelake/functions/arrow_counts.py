"""Per-batch byte counting inside tasks (Arrow buffers + numpy), used through ``mapInArrow``.

Spark partitions the input and aggregates the small per-task tables; numpy only replaces the
per-byte explode that would otherwise create one row per byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def value_bytes(arr: pa.Array):
    """(flat uint8 bytes, int64 offsets rebased to 0) of a string/binary Arrow array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    odt = np.int64 if large else np.int32
    bufs = arr.buffers()
    offsets = np.frombuffer(bufs[1], dtype=odt, count=len(arr) + 1, offset=arr.offset * np.dtype(odt).itemsize)
    offsets = offsets.astype(np.int64)
    if bufs[2] is None or len(arr) == 0:
        return np.zeros(0, np.uint8), offsets - offsets[0] if len(offsets) else offsets
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


BLOCK = 1 << 18  # positions worked on at once: a few MB of 64-bit codes, however long the values are


def count_bytes(data: np.ndarray) -> np.ndarray:
    """How often each byte value stands in ``data``."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(data), BLOCK):
        counts += np.bincount(data[at : at + BLOCK], minlength=256)
    return counts


def ngram_blocks(data: np.ndarray, offsets: np.ndarray, k: int, with_owner: bool = False):
    """Codes ``ctx * 256 + next`` for every position with k preceding bytes in the same value
    (and, with ``with_owner``, the row index each position belongs to), block by block of positions."""
    n = len(data)
    starts = offsets[:-1]
    for lo in range(k, n, BLOCK):
        hi = min(n, lo + BLOCK)
        code = data[lo:hi].astype(np.int64)
        for j in range(1, k + 1):
            code += data[lo - j : hi - j].astype(np.int64) << (8 * j)
        # a position is valid unless one of the values starts at it or less than k before it
        ok = np.ones(hi - lo, bool)
        near = starts[np.searchsorted(starts, lo - k, side="right") : np.searchsorted(starts, hi)]
        for j in range(k):
            at = near + (j - lo)
            ok[at[(at >= 0) & (at < hi - lo)]] = False
        if with_owner:
            yield code[ok], (np.searchsorted(offsets, np.arange(lo, hi), side="right") - 1)[ok]
        else:
            yield code[ok], None


def compare_bytes(gen: pa.Array, ref: pa.Array):
    """``(row, pos, equal)`` over the common prefixes of two binary columns; nulls are empty."""
    g, go = value_bytes(gen)
    r, ro = value_bytes(ref)
    n = np.minimum(np.diff(go), np.diff(ro))
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, pos, g[go[row] + pos] == r[ro[row] + pos], n
