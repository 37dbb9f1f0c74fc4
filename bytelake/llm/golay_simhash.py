"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A (23 bits), B (23 bits) and C (18 bits).  For two fingerprints
that differ in at most two bits, pigeonhole leaves one of three cases: A is equal; B is equal; or C is
equal and A and B differ in one bit each.  The equal segment is one part of a key.  The other part is the
Golay index of another segment, which tolerates its (at most two) errors: the binary Golay code [23, 12]
decodes every 23-bit word to exactly one codeword, and a word is given the indices decoded from itself and
from its 23 one-bit neighbours (six at most differ).  Two words at distance two or less have a word within
one bit of both, so they share an index.  Keys meet in an equi-join and the real bit distance is verified.

A key shared by very many different fingerprints (``crowded``) is not paired: its fingerprints emit
themselves and their 64 one-bit neighbours instead.  Fingerprints that meet on such a word are within two
bits by construction (and any two within two bits do meet on one), at most 65 meet, and each is linked to
the smallest: exact, without pairs.  Links join different fingerprints only; equal ones are one node.

Defined results: a null text counts as empty (fingerprint zero); equal ids or equal rows are separate rows
of one component; ``component_id`` ignores null ids (null if the component has no other); empty table:
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small, stored, text_or_empty
from .components import components
from .registry import query, table

SHINGLE = 3
MAX_BITS = 2  # the Golay keys and the one-bit words are made for two bits
CROWDED = 64
GOLAY_POLYNOMIAL = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Majority bits of the XXH64 values of all word shingles (ASCII lower case, ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _remainders() -> np.ndarray:
    """Remainder of x^i by the Golay polynomial, for the 23 bit positions."""
    out = []
    for i in range(23):
        r = 1 << i
        for j in range(i, 10, -1):
            if r >> j & 1:
                r ^= GOLAY_POLYNOMIAL << (j - 11)
        out.append(r)
    return np.array(out, np.int64)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """``(remainders, errors)``: the error pattern (three bits at most) of each of the 2,048 syndromes."""
    rem = _remainders()
    errors = np.zeros(2048, np.int64)
    bits = range(23)
    patterns = [(i,) for i in bits] + [(i, j) for i in bits for j in range(i)] + [(i, j, k) for i in bits for j in range(i) for k in range(j)]
    for p in patterns:
        errors[np.bitwise_xor.reduce(rem[list(p)])] = sum(1 << i for i in p)
    return rem, errors


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Per 23-bit word, the message numbers (12 bits) decoded from it and its 23 one-bit neighbours: shape (n, 24)."""
    rem, errors = golay_tables()
    near = words[:, None] ^ np.concatenate(([0], 1 << np.arange(23)))[None, :]
    syndrome = np.zeros(near.shape, np.int64)
    for i in range(23):
        syndrome ^= np.where(near >> i & 1, rem[i], 0)
    return (near ^ errors[syndrome]) >> 11


def golay_keys(fps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(key, fingerprint)`` rows: the equal segment with each distinct index of the fuzzy one."""
    fp = np.array(fps, np.int64)
    a, b, c = fp & 0x7FFFFF, fp >> 23 & 0x7FFFFF, fp >> 46 & 0x3FFFF
    in_a, in_b = golay_indices(a), golay_indices(b)
    keys, owners = [], []
    for case, exact, fuzzy in ((1, a, in_b), (2, b, in_a), (3, c, in_a)):
        k = np.sort(case << 40 | exact[:, None] << 12 | fuzzy, axis=1)
        new = np.concatenate((np.ones((len(fp), 1), bool), k[:, 1:] != k[:, :-1]), axis=1)
        keys.append(k[new])
        owners.append(np.repeat(fp, new.sum(axis=1)))
    return np.concatenate(keys), np.concatenate(owners)


def _one_bit_words(fps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    fp = np.array(fps, np.int64)
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64))).view(np.int64)
    return (fp[:, None] ^ flips[None, :]).ravel(), np.repeat(fp, 65)


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links ``(u, v)`` between the distinct fingerprints ``fps (fp)`` whose components are those of all
    pairs at most two bits apart."""
    keys = stored(map_rows(fps.select("fp"), lambda c: golay_keys(c["fp"]), "key long, fp long", 4096), "golay-keys")
    sizes = keys.groupBy("key").count().filter("count > 1")
    few = keys.join(sizes.filter(F.col("count") <= crowded).select("key"), "key", "left_semi")
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    many = keys.join(sizes.filter(F.col("count") > crowded).select("key"), "key", "left_semi").select("fp").distinct()
    words = stored(map_rows(many, lambda c: _one_bit_words(c["fp"]), "word long, fp long", 1024), "one-bit-words")
    least = words.groupBy("word").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("word", "v")
    stars = words.join(least, "word").filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars)


def _labelled(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """``(_id, _h, fp, root, component_id)`` per row; ``_h`` is a hash of the text, ``root`` the smallest
    fingerprint of the component."""

    def run(cols):
        signed = np.array([fingerprint(t, shingle) for t in cols["_t"]], np.uint64).view(np.int64)
        return cols["_id"], cols["_h"], signed

    body = text_or_empty(text)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(body).alias("_h"), body.alias("_t"))
    rows = stored(map_rows(rows, run, f"_id {kind}, _h long, fp long"), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("_id").alias("_least")), "distinct-fingerprints")
    roots = components(links(nodes))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    label = named.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return rows.join(label, "fp")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per document: ``(id, fp, component_id)``; ``fp`` is the fingerprint as a signed long."""
    if max_bits != MAX_BITS:
        raise ValueError("the Golay keys are complete for two differing bits")
    return _labelled(docs, id_col, text, shingle).select(F.col("_id").alias(id_col), "fp", "component_id")


def keep_one_per_component(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id (a null id only if there is no
    other; then the smallest text hash; of equal rows any)."""
    if max_bits != MAX_BITS:
        raise ValueError("the Golay keys are complete for two differing bits")
    texts = _labelled(docs, id_col, text, shingle).groupBy("_id", "_h", "root").agg(F.count(F.lit(1)).alias("_times"))
    texts = stored(texts, "texts")
    best = texts.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_h")).alias("_best"))
    stays = F.col("_id").eqNullSafe(F.col("_best._id")) & (F.col("_h") == F.col("_best._h"))
    judged = texts.join(best, "root")
    gone = judged.filter(~stays).select(F.col("_id").alias("_gone_id"), F.col("_h").alias("_gone_h"))
    gone = small(stored(gone, "near-copies"))
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text)).alias("_h"))
    same = rows["_id"].eqNullSafe(gone["_gone_id"]) & (rows["_h"] == gone["_gone_h"])
    kept = rows.join(gone, same, "left_anti")
    again = small(stored(judged.filter(stays & (F.col("_times") > 1)).select("_h", F.lit(True).alias("_again")), "repeated-rows"))
    kept = kept.join(again, "_h", "left")
    once = kept.filter("_again IS NULL").select("_doc.*")
    return once.unionByName(kept.filter("_again").dropDuplicates(["_h"]).select("_doc.*"))


@query("op6_golay_simhash")
def op6(spark, sf_dir):
    found = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
