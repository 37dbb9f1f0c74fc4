"""Removal of repeated byte strings: suffixes are sampled, named, named again, merged and compared.

A byte goes if it lies in a string of ``length`` bytes that also starts somewhere else in the corpus.  The steps
are those of difference-cover suffix sorting, with two changes that make it fit a cluster's disks (see README):
the sample is chosen by content, and suffixes are compared only as far as ``length`` bytes, so equal names stand for
neighbours in the suffix array whose common prefix is long enough.

1. Sample.  Of each ``length``-byte string one K-byte substring is sampled: the one with the smallest hash.  Like the
   residues of a difference cover, the samples of two equal strings lie at the same offset; but there are about
   2 / (length - K + 2) of all positions instead of two thirds.
2. Names.  A sampled position is named by its K bytes.  A string whose sample has a name of its own can't
   repeat.  A bit table of 2^bits slots (a size given by a parameter), of which each name has two, tells in
   a second scan which strings may repeat; names that share slots by chance cost work, never a result.  What is left is the
   reduced text: the regions whose samples' names occur again.
3. Names again.  The starts that share a sample form a run; the run's whole context (from its first start to the end of its last
   string) is named next.  A context that occurs twice settles all its starts at once.
4. Merge.  The starts of contexts that occur once (the ends of repeats) are merged with those of one
   representative of each repeated context of the same sample name: every start gets the name of its ``length`` bytes.
5. Compare.  A name that two starts share is a repeat.

Names are 128-bit hashes and are only ever counted and joined, so a passage in a third of all documents is a
partial sum per task and a join key that Spark may split.

Defined results: a null text counts as empty; equal rows are separate documents, so they repeat each other; texts shorter than ``length``
lose nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, small, stored, text_or_empty
from .registry import query, table

LENGTH = 400
SAMPLE = 300  # K
BITS = 28
SEGMENT = 1 << 18  # starts handled at once, which bounds a task's memory whatever the text's length
BROADCAST_RANGES = 2_000_000  # removed ranges joined by broadcast; beyond it by a shuffle

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if n not in _powers:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _powers[n] = np.cumprod(up), np.cumprod(down)
    return _powers[n]


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte substring, from prefix sums."""
    up, down = _power_table(SEGMENT + (1 << 12))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x.astype(np.uint64) * up[: len(x)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(x) - k + 1]
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    out, size = a, 1
    while size * 2 <= w:
        out, size = pick(out[:-size], out[size:]), size * 2
    return pick(out[: -(w - size)], out[w - size :]) if w > size else out


def _segments(data: bytes, length: int):
    """``(first start, bytes)``: the bytes of at most SEGMENT starts."""
    for at in range(0, len(data) - length + 1, SEGMENT):
        yield at, data[at : at + SEGMENT + length - 1]


def _minima(part: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes of all K-byte substrings, smallest hash within each start's string)``."""
    h = gram_hashes(np.frombuffer(part, np.uint8), k)
    return h, _sliding(h, length - k + 1, np.minimum)


def sample_names(data: bytes, length: int, k: int) -> list[np.ndarray]:
    """Names of all sampled positions (each tied position counts)."""
    out = []
    for _, part in _segments(data, length):
        h, low = _minima(part, length, k)
        pad = np.zeros(length - k, np.uint64)
        out.append(h[_sliding(np.concatenate((pad, low, pad)), length - k + 1, np.maximum) == h])
    return out


def _slots(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each name."""
    return (names >> np.uint64(64 - bits)).astype(np.int64), (names & np.uint64((1 << bits) - 1)).astype(np.int64)


def _slot_counts(cols, length, k, bits):
    names = [n for t in cols["_t"] for n in sample_names(t.encode("utf-8", "surrogatepass"), length, k)]
    if not names:
        return [], []
    slots, n = np.unique(np.concatenate(_slots(np.concatenate(names), bits)), return_counts=True)
    return slots, np.minimum(n, 2)


def _bit_table(spark: SparkSession, slots: DataFrame, bits: int) -> np.ndarray:
    """One bit per slot that two or more sampled positions share; 2^bits / 8 bytes whatever the input."""
    twice = slots.groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1")
    place = twice.select(F.shiftright("slot", 15).alias("part"), F.col("slot").bitwiseAND(F.lit(32767)).alias("bit"))
    out = np.zeros(max(1, (1 << bits) >> 15) * 4096, np.uint8)
    for row in place.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _bits_at(table_of_bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table_of_bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1


def _name128(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def regions(data: bytes, table_of_bits: np.ndarray, length: int, k: int, bits: int):
    """The reduced text of a document: ``(first start, bytes, run starts, run ends, sample names, tied, context names)`` of
    each maximal stretch of starts that may repeat."""
    for at, part in _segments(data, length):
        h, low = _minima(part, length, k)
        new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        first, second = _slots(low[new], bits)
        shared = _bits_at(table_of_bits, first) & _bits_at(table_of_bits, second)
        if not shared.any():
            continue
        may = np.repeat(shared, np.diff(np.concatenate((new, [len(low)]))))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], may, [0]))))
        for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            own = low[b:e]
            starts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
            ends = np.concatenate((starts[1:], [e - b]))
            body = part[b : e + length - 1]
            tied, names = [], []
            for s, t in zip(starts.tolist(), ends.tolist(), strict=True):
                tied.append(bool(np.count_nonzero(h[b + s : b + t + length - k] == own[s]) > 1))
                names.append(_name128(body[s : t + length - 1]))
            both = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
            yield at + b, body, starts.astype(np.int32), ends.astype(np.int32), own[starts].view(np.int64), tied, both[:, 0], both[:, 1]


def _reduced(cols, shared, length, k, bits):
    out = [[] for _ in range(10)]
    for doc, h, text in zip(cols["_id"], cols["_h"], cols["_t"], strict=True):
        for found in regions(text.encode("utf-8", "surrogatepass"), shared.value, length, k, bits):
            for column, value in zip(out, (doc, h, *found), strict=True):
                column.append(value)
    return out


def _start_names(cols, length, payload: bool):
    """Names of the starts of the listed runs of each region; with ``payload``, region and start as well."""
    names, keys, places = [], [], []
    for key, body, runs in zip(cols["_key"], cols["body"], cols["runs"], strict=True):
        for run in runs:
            b, e = run["b"], run["e"]
            names += [_name128(body[p : p + length]) for p in range(b, e)]
            if payload:
                keys.append(np.full(e - b, key, np.int64))
                places.append(np.arange(b, e, dtype=np.int32))
    both = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
    if not payload:
        return both[:, 0], both[:, 1]
    empty = [np.zeros(0, np.int64)]
    return both[:, 0], both[:, 1], np.concatenate(keys or empty), np.concatenate(places or empty)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def _byte_ranges(cols, length):
    """The removed bytes of each region, from its repeated starts."""
    begins, ends = [], []
    for at, starts in zip(cols["at"], cols["starts"], strict=True):
        spans = _merged([(at + s["b"], at + s["e"] - 1 + length) for s in starts])
        begins.append([b for b, _ in spans])
        ends.append([e for _, e in spans])
    return cols["_id"], cols["_h"], begins, ends


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """``(_id, _h, begins, ends)``: byte ranges to remove of each region of a document, ``_h`` a hash of its text."""
    if not 0 < sample < length <= 1 << 12:
        raise ValueError("needs 0 < sample < length <= 4096")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    body = text_or_empty(text)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(body).alias("_h"), body.alias("_t")).filter(F.octet_length("_t") >= length)

    slots = map_rows(rows.select("_t"), lambda c: _slot_counts(c, length, sample, bits), "slot long, n long")
    shared = spark.sparkContext.broadcast(_bit_table(spark, slots, bits))
    reduced = map_rows(
        rows, lambda c: _reduced(c, shared, length, sample, bits),
        f"_id {kind}, _h long, at long, body binary, b array<int>, e array<int>, m array<long>, tied array<boolean>, d1 array<long>, d2 array<long>", 64,
    )
    reduced = stored(reduced.withColumn("_key", F.monotonically_increasing_id()), "reduced-text")

    runs = reduced.select("_key", F.explode(F.arrays_zip("b", "e", "m", "tied", "d1", "d2")).alias("r")).select("_key", "r.*")
    again = runs.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.max("tied").alias("t")).filter("n > 1 OR t").select("m")
    runs = stored(runs.join(again, "m", "left_semi"), "runs")
    contexts = runs.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_key", "b")).alias("first"))
    judged = runs.join(contexts, ["d1", "d2"]).select(
        "_key", "b", "e", "m", (F.col("n") == 1).alias("once"), (F.col("first") == F.struct("_key", "b")).alias("stands")
    )
    judged = stored(judged, "judged-runs")
    once = judged.filter("once")
    stand_ins = judged.filter("NOT once AND stands").join(once.select("m").distinct(), "m", "left_semi")

    def starts(of: DataFrame, payload: bool) -> DataFrame:
        lists = of.groupBy("_key").agg(F.collect_list(F.struct("b", "e")).alias("runs"))  # one region's own runs
        lists = small(stored(lists, "run-lists"))
        schema = "g1 long, g2 long" + (", _key long, p int" if payload else "")
        return map_rows(reduced.select("_key", "body").join(lists, "_key"), lambda c: _start_names(c, length, payload), schema, 64)

    every = starts(once.select("_key", "b", "e").unionByName(stand_ins.select("_key", "b", "e")), False)
    shared_names = every.groupBy("g1", "g2").count().filter("count > 1").select("g1", "g2")
    hits = starts(once, True).join(shared_names, ["g1", "g2"], "left_semi").select("_key", F.col("p").alias("b"), (F.col("p") + 1).alias("e"))

    found = hits.unionByName(judged.filter("NOT once").select("_key", "b", "e"))
    found = found.groupBy("_key").agg(F.collect_list(F.struct("b", "e")).alias("starts"))  # one region's own starts
    placed = reduced.select("_key", "_id", "_h", "at").join(found, "_key").select("_id", "_h", "at", "starts")
    return map_rows(placed, lambda c: _byte_ranges(c, length), f"_id {kind}, _h long, begins array<long>, ends array<long>")


def _cut(cols):
    """Kept bytes of each text without its ranges."""
    kept, sizes, begins, ends = [], [], [], []
    for text, bs, es in zip(cols["_t"], cols["begins"], cols["ends"], strict=True):
        data = text.encode("utf-8", "surrogatepass")
        spans = _merged(list(zip((x for b in bs or () for x in b), (x for e in es or () for x in e), strict=True)))
        at, parts = 0, []
        for b, e in spans:
            parts.append(data[at:b])
            at = e
        kept.append(b"".join([*parts, data[at:]]) if spans else data)
        sizes.append(len(data))
        begins.append([b for b, _ in spans])
        ends.append([e for _, e in spans])
    return cols["_id"], sizes, begins, ends, kept


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """One row per document: ``(id, n_bytes, begins, ends, kept)``: the removed byte ranges and the bytes left."""
    ranges = repeated_ranges(docs, id_col, text, length, sample, bits)
    ranges = ranges.groupBy("_id", "_h").agg(F.collect_list("begins").alias("begins"), F.collect_list("ends").alias("ends"))  # one document's own
    ranges = stored(ranges, "ranges").withColumnsRenamed({"_id": "_rid", "_h": "_rh"})
    size = ranges.agg(F.coalesce(F.sum(F.size(F.flatten("begins")) + 2), F.lit(0))).first()[0]
    if size <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    kind = docs.schema[id_col].dataType.simpleString()
    body = text_or_empty(text)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(body).alias("_h"), body.alias("_t"))
    rows = rows.join(ranges, rows["_id"].eqNullSafe(ranges["_rid"]) & (rows["_h"] == ranges["_rh"]), "left")
    out = map_rows(
        rows.select("_id", "_t", "begins", "ends"), _cut, f"_id {kind}, n_bytes long, begins array<long>, ends array<long>, kept binary", 64
    )
    return out.withColumnRenamed("_id", id_col)


@query("op9_suffix_dedup")
def op9(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("begins").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
