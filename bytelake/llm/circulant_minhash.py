"""MinHash near-dedup with circulant signatures.

Two permutations give all coordinates.  The first places each shingle at one of 2^32 positions (its hash).  The second, a bijection of
the positions, is circularly shifted by 0, 1, 2, ...: coordinate k is the least value of ``second(place - k)`` over the set.

1. Sets.  Each text's set of 5-word shingles is hashed (64 bits each).  Texts with one set are one node, whatever their number.
2. Bands.  32 bands of six coordinates; sets that share a band meet.  A pair at similarity 0.85 is missed with probability 3e-7.
3. Stars.  Each node is verified against one node of each of its bands, the one that meets most others in all its bands (of near copies the text they
   were made from): one pair a node and band at most, so a group of near copies costs a pair a copy.
4. Rest.  Links make components; only bands that hold several are still open.  In an order of all shingles (rarest first, by a table of counts
   with two slots or more a shingle, 64 MB at most) two similar sets share a shingle that leaves enough behind it in both, so the open nodes meet again on such shingles, and only
   pairs of different components count: copies too far from all others have none.  Groups of at most
   ``crowded`` nodes verify all such pairs; in larger ones a few nodes of the smallest components (twice as many each round) are verified against the others and leave, until
   one component or a small group is left.  So no link is lost.
5. Verification.  Both full sets meet in one task: the partners of a node in slices of a bounded number, each with the node's set.  Sizes
   are compared first, then intersections are counted exactly.  The narrow lists of pairs and open nodes go to the sets (by broadcast up to
   ``common.SMALL_ROWS`` rows), so sets are shuffled only to meet their partners.

Defined results: nulls and texts without words have an empty set, linked with nothing (their component is their own id); equal rows
are separate rows of one component; ``component_id`` ignores null ids (null if there is no other); ``kept`` is false for a null id; empty
table: empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, small, stored, text_or_empty
from .components import components
from .registry import query, table

SHINGLE = 5
PERCENT = 85
BANDS = 32
ROWS = 6
CROWDED = 64
HUBS = 16
SLICE = 256  # partners verified against a node at once
LEAST_BITS, MOST_BITS, PARTS = 22, 26, 10  # slots of the table of shingle counts (a byte each), and the parts they are summed in (powers of two)

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(32))) * m
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (ASCII lower case and white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(w))
    h = np.full(len(w) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        h = _mixed(h + w[k : len(w) - width + 1 + k])
    return np.unique(h)


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A bijection of the 32-bit positions (xor-shifts and odd factors)."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a non-empty set; shift k of the second permutation is ``second(place - k)``."""
    place = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, np.uint32(0xFFFFFFFF))
    for at in range(0, len(place), 1 << 14):  # bounded memory for very long texts
        part = place[at : at + (1 << 14)]
        step = max(1, (1 << 15) // len(part))  # shifts done at once: what the cache holds
        for k in range(0, size, step):
            shifts = np.arange(k, min(size, k + step), dtype=np.uint32)
            least = second_permutation(part[None, :] - shifts[:, None]).min(axis=1)
            np.minimum(out[k : k + step], least, out=out[k : k + step])
    return out


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key for each band."""
    coordinates = signature(hashes, bands * rows).reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        h = _mixed(h + coordinates[:, k])
    return h.view(np.int64)


def _sketches(cols, shingle, bands, rows):
    n, d1, d2, keys = [], [], [], []
    for text in cols["_t"]:
        hashes = shingle_set(text, shingle)
        name = xxhash.xxh3_128_intdigest(hashes.tobytes())
        n.append(len(hashes))
        d1.append((name >> 64) - (1 << 63))
        d2.append((name & ((1 << 64) - 1)) - (1 << 63))
        keys.append(band_keys(hashes, bands, rows).tolist() if len(hashes) else None)
    return cols["_id"], cols["_h"], n, d1, d2, keys


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v, nu, nv)`` of nodes whose full sets ``sets (node, grams)`` are similar enough: ``(u, v)``."""
    near = pairs.filter(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent).select("u", "v").distinct()
    near = stored(near, "candidate-pairs")
    sizes = near.groupBy("u").count().select("u", F.ceil(F.col("count") / SLICE).alias("slices"))
    part = F.pmod(F.xxhash64("v"), F.col("slices"))
    dealt = near.join(sizes, "u").select("u", F.col("v").alias("node"), part.alias("slice"))
    hubs = sizes.select("u", F.col("u").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    rows = small(stored(dealt.unionByName(hubs), "sides")).join(sets, "node")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(key, group):
        hub = key[0].as_py()
        nodes = group.column("node").to_pylist()
        grams = [np.frombuffer(g.as_py(), np.uint64) for g in group.column("grams")]
        own = grams[nodes.index(hub)] if hub in nodes else np.zeros(0, np.uint64)
        found = []
        for node, other in zip(nodes, grams, strict=True):
            if node != hub:
                at = np.minimum(np.searchsorted(own, other), max(len(own) - 1, 0))
                both = int((own[at] == other).sum()) if len(own) else 0
                if 100 * both >= percent * (len(own) + len(other) - both):
                    found.append(node)
        return pa.Table.from_arrays([pa.array([hub] * len(found), pa.int64()), pa.array(found, pa.int64())], schema=schema)

    return stored(rows.groupBy("u", "slice").applyInArrow(compare, "u long, v long"), "links")


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.int64)


def _slot_counts(cols, bits):
    slots, n = np.unique(np.concatenate([_slots(np.frombuffer(g, np.uint64), 1 << bits) for g in cols["grams"]]), return_counts=True)
    within = bits - PARTS
    edge = np.flatnonzero(np.diff(slots >> within, prepend=-1)).tolist()
    ends = [*edge[1:], len(slots)]
    low, n = (slots & ((1 << within) - 1)).astype(np.uint16), np.minimum(n, 255).astype(np.uint8)
    return slots[edge] >> within, [low[b:e].tobytes() for b, e in zip(edge, ends, strict=True)], [n[b:e].tobytes() for b, e in zip(edge, ends, strict=True)]


def _count_table(sets: DataFrame, shingles: int) -> np.ndarray:
    """How many sets' shingles fall on each slot, 255 at most; two to four slots for each of ``shingles`` (all in the sets), 64 MB at most."""
    schema = pa.schema([("part", pa.int64()), ("counts", pa.binary())])
    bits = min(MOST_BITS, max(LEAST_BITS, shingles.bit_length() + 1))
    within = bits - PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(1 << within, np.int64), None
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for at, n in zip(batch.column("slots"), batch.column("counts"), strict=True):
                total[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()])], schema=schema)

    parts = map_rows(sets.select("grams"), lambda c: _slot_counts(c, bits), "part long, slots binary, counts binary", 1024)
    out = np.zeros(1 << bits, np.uint8)
    sums = stored(parts.groupBy("part").applyInArrow(add, "part long, counts binary"), "shingle-counts")  # few files to read, not a job a partition
    for row in sums.toLocalIterator():
        out[row["part"] << within : (row["part"] + 1) << within] = np.frombuffer(row["counts"], np.uint8)
    return out


def prefix(hashes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``(shingles, places)`` of a set's first shingles, rarest first, one of which any similar set has among its own first ones; those no other set
    holds are left out."""
    n = counts[_slots(hashes, len(counts))]
    first = np.lexsort((hashes, n))[: len(hashes) + percent * len(hashes) // -100 + 1]
    at = np.flatnonzero(n[first] > 1)
    return hashes[first[at]].view(np.int64), at


def _prefix_rows(cols, shared, percent):
    found = [prefix(np.frombuffer(g, np.uint64), shared.value, percent) for g in cols["grams"]]
    sizes = [len(at) for _, at in found]
    n = [len(g) // 8 for g in cols["grams"]]
    keys, at = (np.concatenate(c) for c in zip(*found, strict=True))
    return keys, np.repeat(np.array(cols["node"], np.int64), sizes), np.repeat(np.array(n, np.int64), sizes), at


def _needed(n, m, percent: int):
    """The least intersection of similar sets of n and m shingles."""
    return F.ceil((n + m) * percent / F.lit(100 + percent))


def _reachable(rows: DataFrame, percent: int) -> DataFrame:
    """Without the rows whose shingle leaves too few behind it for any set it may meet."""
    least = rows.groupBy("key").agg(F.min("n").alias("_m"))
    other = F.greatest(F.col("_m"), F.ceil(F.col("n") * percent / 100))
    return rows.join(least, "key").filter(F.col("n") - F.col("at") >= _needed(F.col("n"), other, percent)).drop("_m")


def _open_bands(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Band members ``(key, node, n)`` with their component ``root``, of the bands that hold more than one component."""
    named = members.join(roots, members["node"] == roots["node"], "left").select("key", members["node"], "n", "at", F.coalesce("root", members["node"]).alias("root"))
    several = named.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b")
    return stored(named.join(several.select("key", "size"), "key"), "open-bands")


def _pairs(a: DataFrame, b: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle with enough behind it in both sets."""
    a, b = a.alias("a"), b.alias("b")
    behind = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    near = behind >= _needed(F.col("a.n"), F.col("b.n"), percent)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & near)
    u, v = F.struct("a.node", "a.n"), F.struct("b.node", "b.n")
    met = met.select(F.least(u, v).alias("x"), F.greatest(u, v).alias("y"))
    return met.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.col("x.n").alias("nu"), F.col("y.n").alias("nv"))


def _linked(members: DataFrame, sets: DataFrame, percent: int, crowded: int, hubs: int) -> DataFrame:
    """The components ``(node, root)`` of all pairs similar enough that share a band; nodes without a link are not listed."""
    met = small(stored(members.groupBy("node").agg(F.sum(-F.col("size")).alias("met")), "met-nodes"))
    first = members.join(met, "node").groupBy("key").agg(F.min(F.struct("met", "node", "n")).alias("hub"))
    stars = members.join(first, "key").filter("node <> hub.node")
    stars = _verified(stars.select(F.col("hub.node").alias("u"), F.col("node").alias("v"), F.col("hub.n").alias("nu"), F.col("n").alias("nv")), sets, percent)
    roots = components(stars)
    nodes = small(stored(_open_bands(members.withColumn("at", F.lit(0)), roots).select("node", "n").distinct(), "open-nodes"))
    unsettled = sets.join(nodes, "node", "left_semi")
    shingles = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = sets.sparkSession.sparkContext.broadcast(_count_table(unsettled, shingles))
    left = map_rows(unsettled, lambda c: _prefix_rows(c, counts, percent), "key long, node long, n long, at long")
    left = _open_bands(_reachable(stored(left, "prefixes"), percent), roots)
    while not left.isEmpty():
        few = left.filter(F.col("size") <= crowded)
        many = left.filter(F.col("size") > crowded)
        weight = many.groupBy("key", "root").agg(F.count(F.lit(1)).alias("w"))
        # a group's hubs are members of its smallest components; salted parts are cut first, so no task orders a whole group
        chosen = many.join(weight, ["key", "root"]).withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(64)))
        for keys in (["key", "_salt"], ["key"]):
            order = Window.partitionBy(*keys).orderBy("w", "root", "node")
            chosen = chosen.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= hubs)
        chosen = stored(chosen.select("key", "root", "node", "n", "at"), "hubs")
        more = _verified(_pairs(few, few, percent).unionByName(_pairs(chosen, many, percent)), sets, percent)
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
        left = many.select("key", "node", "n", "at").join(chosen.select("key", "node"), ["key", "node"], "left_anti")
        left = _open_bands(left, roots)
        hubs *= 2
    return roots


def minhash_components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    bands: int = BANDS, rows: int = ROWS, crowded: int = CROWDED, hubs: int = HUBS,
) -> DataFrame:
    """One row per document: ``(id, n_shingles, component_id, kept)``."""
    kind = docs.schema[id_col].dataType.simpleString()
    body = text_or_empty(text)
    named = docs.select(F.col(id_col).alias("_id"), F.xxhash64(body).alias("_h"), body.alias("_t"))
    schema = f"_id {kind}, _h long, n long, d1 long, d2 long, keys array<long>"
    sketches = stored(map_rows(named, lambda c: _sketches(c, shingle, bands, rows), schema), "sketches")
    nodes = sketches.filter("n > 0").groupBy("d1", "d2").agg(
        F.min("_id").alias("least"), F.min(F.struct("_id", "_h")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"),
        F.count(F.lit(1)).alias("copies"),
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    met = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = small(stored(met.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared-bands"))
    members = stored(met.join(shared, "key").select("key", "node", "n", "size"), "band-members")
    involved = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "rep._id", "rep._h", "copies")
    involved = stored(involved.withColumnsRenamed({"_id": "_rid", "_h": "_rh"}), "candidate-nodes")

    def full(of: DataFrame) -> DataFrame:
        of = small(of)
        texts = named.join(of, named["_id"].eqNullSafe(of["_rid"]) & (named["_h"] == of["_rh"])).select("node", "_t")
        return map_rows(texts, lambda c: (c["node"], [shingle_set(t, shingle).tobytes() for t in c["_t"]]), "node long, grams binary")

    again = full(involved.filter("copies > 1")).groupBy("node").agg(F.first("grams").alias("grams"))  # rows with one id and text
    sets = stored(full(involved.filter("copies = 1")).unionByName(again), "full-sets")
    roots = _linked(members, sets, percent, crowded, hubs).withColumnRenamed("node", "_node")
    rooted = nodes.join(roots, nodes["node"] == roots["_node"], "left").select("d1", "d2", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    label = rooted.join(least, "root").select("d1", "d2", "component")
    out = sketches.select("_id", "n", "d1", "d2").join(label, ["d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component"))
    kept = F.coalesce(F.col("_id") == component, F.lit(False))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


@query(
    "op13_circulant_minhash",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, list_filter(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    s AS (
      SELECT doc_id, list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)]) AS grams FROM d),
    g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
    size AS (SELECT doc_id, len(grams) AS n FROM s),
    shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT u, v FROM shared JOIN size AS x ON x.doc_id = u JOIN size AS y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
    edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    reach AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, e.v FROM reach AS r JOIN edges AS e ON e.u = r.other),
    root AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
    SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM size JOIN root ON node = doc_id
    """,
)
def op13(spark, sf_dir):
    return minhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
