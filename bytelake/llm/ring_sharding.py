"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2^63 positions; a key belongs to the arc that ends at the
next point clockwise.  Shards have a capacity in rows (the total divided as evenly as integers allow, so
full shards hold counts at most one apart).  Keys are offered to the shard of their own arc first; what a
full shard can't take continues clockwise to the next point, round by round.

Only counts decide: the rows of each arc are counted (``shards * vnodes`` numbers, a bound given by the
parameters), the rounds run on those counts, and each arc gets a list of rank ranges with their shard and
first slot.  The rows are ranked inside their arc (arcs are ~1/(shards*vnodes) of the rows each) and meet
that bounded table in a broadcast join.

Defined results: a null text has size 8 and crc 0; a null id hashes like any key; equal ids share an arc and
are ordered by size and crc (equal rows are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .registry import query, table

SHARDS = 24
VNODES = 128
_RING = 1 << 63


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted ``(position, shard)``; a point depends on its shard and number only, so a new shard
    adds points and moves none."""
    points = [
        (int.from_bytes(hashlib.sha256(f"shard-{s}/{v}".encode()).digest()[:8], "big") % _RING, s)
        for s in range(shards)
        for v in range(vnodes)
    ]
    return sorted(points)


def place_counts(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """``(arc, first rank, end rank, shard, first slot)`` for the rows of every arc, in rounds: each arc
    offers what is left of it to the next shard clockwise that it hasn't tried, until all is placed."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    n = len(points)
    left = {a: [0, c, a, set()] for a, c in sorted(counts.items()) if c}
    placed = []
    while left:
        for arc in list(left):
            rank, count, at, tried = left[arc]
            while points[at % n][1] in tried:
                at += 1
            shard = points[at % n][1]
            tried.add(shard)
            take = min(count, room[shard] - used[shard])
            if take:
                placed.append((arc, rank, rank + take, shard, used[shard]))
                used[shard] += take
            if take == count:
                del left[arc]
            else:
                left[arc] = [rank + take, count - take, at + 1, tried]
    return placed


def ring_shards(
    docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``(id, size, text_crc32, law, shard, slot, grown_shard)``."""
    spark = docs.sparkSession
    body = text_or_empty(text)
    points = ring_points(shards, vnodes)
    key = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(_RING - 1))
    rows = docs.select(
        F.col(id_col), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), key.alias("_key")
    )
    ends = F.expr("array(" + ", ".join(f"{p}L" for p, _ in points) + ")")
    rows = rows.withColumn("_ends", ends).withColumn("_arc", _arc_of("_key", "_ends", len(points))).drop("_ends")
    rows = stored(rows, "ring-rows")
    counts = {r["_arc"]: r["n"] for r in rows.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = spark.createDataFrame(
        place_counts(counts, points, shards), "_a int, _from long, _to long, shard int, _first long"
    )
    order = Window.partitionBy("_arc").orderBy("_key", id_col, "size", "text_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1)
    hit = (F.col("_arc") == F.col("_a")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(placed), hit).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _arc_of(key: str, ends: str, n: int):
    """Number of the first of ``n`` sorted positions that is at or after the key (around the ring): a
    binary search by halving steps over the constant array."""
    steps = range(n.bit_length() - 1, -1, -1)
    return F.expr(
        f"aggregate(array({', '.join(str(1 << s) for s in steps)}), 0, (low, step) -> "
        f"CASE WHEN low + step <= {n} AND {ends}[low + step - 1] < {key} THEN low + step ELSE low END) % {n}"
    )


@query("op8_ring_sharding")
def op8(spark, sf_dir):
    return ring_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
