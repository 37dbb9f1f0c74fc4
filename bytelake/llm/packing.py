"""Packing by power-of-two decomposition.

A document's token ids (with the end id) are cut into pieces whose lengths are the binary digits of its
length: as many pieces of ``max_len`` as fit, then one piece for each bit of the rest, largest first.  Each
piece is a training sequence of its own, so no sequence crosses documents and none needs padding.  Pieces are written once, brought
together by bucket (log2 of the length) and numbered there, so batches are drawn from a range of sequence ids of one length.

Ids are those of the tokenizer file (a parameter; it must be a byte-level BPE) as loaded: where a text holds one of the
file's added tokens, such as ``<|endoftext|>``, it has that token's id.

Defined results: a null or empty text is one piece holding the end id; equal rows are packed separately (their
pieces are interchangeable); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored, text_or_empty
from .registry import query, table

MAX_LEN = 1024
END_ID = 0
SLOT_BITS = 12  # ranges a bucket when pieces are numbered
CROWDED, CELLS = 50_000, 1024  # equal pieces that are spread, and over how many ranges
_TWO_BLANKS = re.compile(r"\s\s")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, the other bytes for the characters from U+0100 on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of the byte-level BPE file at ``path``.  Its vocabulary (ids in merge order, so they serve as
    ranks) is given to tiktoken, which merges the same way and is about four times as fast (tested against
    the file's own library).  Texts without two white-space characters in a row need no look-ahead."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        byte = byte_alphabet()
        file = Tokenizer.from_file(path)
        vocab = file.get_vocab(with_added_tokens=False)
        self.added = {t.content: i for i, t in file.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in file.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that take in white space or need word edges are not supported")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.splits = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocab.items() if all(c in byte for c in token)}
        for token in self.added:  # not merges
            ranks.pop(token.encode(), None)
        pattern = public_tokenizers.PATTERN
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

    def encode_as_loaded(self, text: str) -> bytes:
        """The ids of the file as loaded, added tokens by their own ids."""
        if self.splits is None or not any(t in text for t in self.added):
            return self.encode(text)
        parts = self.splits.split(text)
        return b"".join(np.array([self.added[x]], "<u4").tobytes() if k % 2 else self.encode(x) for k, x in enumerate(parts))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit numbers, added tokens as ordinary text."""
        encoding = self.full if _TWO_BLANKS.search(text) else self.plain
        return np.array(encoding.encode_ordinary(text), "<u4").tobytes()


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Powers of two that sum to ``n``: ``max_len`` as often as it fits, then the bits of the rest."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << b for b in range(max_len.bit_length() - 2, -1, -1) if rest >> b & 1]


_loaded: dict[str, Tokens] = {}  # one per Python worker


def pack(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_len: int = MAX_LEN, tokenizer: str | None = None,
    end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids])``."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    fields = [("_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    arrow = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded[path] = _loaded.get(path) or Tokens(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                part = batch.slice(at, 128)
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = tokens.encode_as_loaded(body) + end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, max_len):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(own), n, np.frombuffer(own, "<i4"))[: len(arrow)])
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    pieces = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_t")).mapInArrow(run, schema)
    return _bucketed(stored(pieces, "pieces")).select(
        F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"),
        "bucket", *(["ids"] if with_ids else []),
    )


def _bucketed(pieces: DataFrame) -> DataFrame:
    """Groups pieces of equal length: ``bucket`` (log2 of the length) and ``sequence_id``, gapless from 0, shortest bucket first.

    Inside its bucket a piece is placed by a hash of (id, start, ids_crc32), so its number depends on the rows alone, not on partitions.  Ranges
    of that hash are counted (``2^SLOT_BITS`` a bucket, a bounded table) and numbered one by one.  More than ``CROWDED`` equal pieces, such as those
    of one row repeated in number, are spread over ``CELLS`` ranges of their own; which of them gets which number doesn't matter.
    """
    place = F.xxhash64("_id", "start", "ids_crc32")
    rows = pieces.withColumns({"bucket": F.log2("length").cast("int"), "_h": place, "_slot": F.shiftrightunsigned(place, 64 - SLOT_BITS)})
    hot = rows.groupBy("bucket", "_h").count().filter(F.col("count") > CROWDED).select(F.col("bucket").alias("_hb"), F.col("_h").alias("_hot"))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(CELLS))
    rows = rows.withColumn("_spread", spread).join(small(stored(hot, "hot-pieces")), (F.col("bucket") == F.col("_hb")) & (F.col("_h") == F.col("_hot")), "left")
    cell = F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.col("_spread"))
    rows = rows.withColumns({"_cell": cell, "_hot": F.coalesce("_hot", F.lit(0))}).drop("_hb", "_spread")
    range_of = ["bucket", "_slot", "_hot", "_cell"]
    counts = rows.groupBy(*range_of).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*range_of).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*range_of, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    at = F.row_number().over(Window.partitionBy(*range_of).orderBy("_h", "_id", "start", "ids_crc32"))
    rows = rows.join(F.broadcast(offsets), range_of)
    return rows.withColumn("sequence_id", (F.col("_off") + at - 1).cast("long")).drop(*range_of[1:], "_off", "_h")


@query("op10_power_of_two_packing")
def op10(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
