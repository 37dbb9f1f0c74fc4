"""Many draws per group in constant time each: Walker's alias tables, built per chunk of a group.

A group's items are dealt by hash into chunks of about ``chunk`` items, each with an alias table of its own; the chunk masses of a group form an
alias table of the second level.  A draw takes a chunk by one uniform number and an item of it by another, each by one array lookup, so ``m`` draws cost
``m`` lookups and no running sum.  No task holds more than a chunk's items or a group's chunk masses (one number for ``chunk`` items), and
draws are made in blocks, so neither a hot group nor a large ``m`` meets in one row.

Draws are keyed (``u01(seed, "alias", group, draw)``), so they depend neither on partitioning nor on retries.  Weights that are null, NaN or not
positive take no part; items that occur several times in a group count with the sum of their weights; a group without positive weight has no
draws; a null group or item is a value like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rng import u01

CHUNK = 1024
BLOCK = 1024  # draws made in one row
_TABLE = T.StructType().add("keep", T.ArrayType(T.DoubleType())).add("other", T.ArrayType(T.IntegerType())).add("mass", T.DoubleType())


def alias_table(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(keep, other)``: slot ``i`` of the table gives ``i`` with probability ``keep[i]``, else ``other[i]``."""
    n = len(weights)
    scaled = np.asarray(weights, float) * (n / np.sum(weights))
    keep, other = np.ones(n), np.arange(n)
    under, over = list(np.flatnonzero(scaled < 1.0)), list(np.flatnonzero(scaled >= 1.0))
    while under and over:
        lack, rich = under.pop(), over[-1]
        keep[lack], other[lack] = scaled[lack], rich
        scaled[rich] -= 1.0 - scaled[lack]
        if scaled[rich] < 1.0:
            under.append(over.pop())
    return keep, other  # what rounding leaves in either list keeps its own slot


@F.pandas_udf(_TABLE)
def _tables(weights: pd.Series) -> pd.DataFrame:
    made = [alias_table(np.asarray(w)) for w in weights]
    return pd.DataFrame({"keep": [k for k, _ in made], "other": [o.astype(np.int32) for _, o in made], "mass": [float(np.sum(w)) for w in weights]})


def _packed(rows: DataFrame, by: list[str], what: str, weight: str) -> DataFrame:
    """One row per ``by``: its ``what`` values in order, their table and their mass."""
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(what).alias("v"), F.col(weight).alias("w")))).alias("l"))
    return lists.select(*by, F.col("l.v").alias("values"), _tables(F.col("l.w")).alias("t")).select(*by, "values", "t.keep", "t.other", "t.mass")


def build(df: DataFrame, group: str, item: str, weight: str, chunk: int = CHUNK) -> DataFrame:
    """``(group, __chunk, values, keep, other, mass)``: the alias table of each chunk of each group."""
    w = F.col(weight).cast("double")
    rows = df.where((w > 0) & ~F.isnan(w)).groupBy(group, item).agg(F.sum(w).alias("__w"))
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("__chunks"))
    rows = rows.join(sizes, F.col(group).eqNullSafe(F.col("__g"))).withColumn("__chunk", F.pmod(F.xxhash64(item), F.col("__chunks")))
    return _packed(rows, [group, "__chunk"], item, "__w")


def implied_masses(tables: DataFrame, group: str, item: str) -> DataFrame:
    """``(group, item, prob)``: the distribution that the tables stand for, which is the one they were built from."""
    slots = tables.select(group, "values", "mass", F.size("values").alias("n"), F.posexplode(F.arrays_zip("keep", "other")).alias("i", "s"))
    own = F.struct(F.element_at("values", F.col("i") + 1).alias("v"), (F.col("s.keep") * F.col("mass") / F.col("n")).alias("p"))
    lent = F.struct(F.element_at("values", F.col("s.other") + 1).alias("v"), ((1 - F.col("s.keep")) * F.col("mass") / F.col("n")).alias("p"))
    parts = slots.select(group, F.explode(F.array(own, lent)).alias("x")).groupBy(group, F.col("x.v").alias(item)).agg(F.sum("x.p").alias("__p"))
    total = tables.groupBy(F.col(group).alias("__g")).agg(F.sum("mass").alias("__m"))
    return parts.join(total, F.col(group).eqNullSafe(F.col("__g"))).select(group, item, (F.col("__p") / F.col("__m")).alias("prob"))


def _pick(values: Column, keep: Column, other: Column, u: Column) -> Column:
    """The value a uniform number takes: its slot is the whole part of ``u * n``, the rest decides in the slot."""
    x = u * F.size(values)
    slot = F.least(F.floor(x).cast("int"), F.size(values) - 1)
    return F.element_at(values, F.when(x - slot < F.element_at(keep, slot + 1), slot).otherwise(F.element_at(other, slot + 1)) + 1)


def draw(tables: DataFrame, group: str, item: str, m: int, seed: int = 42, out: str = "draw") -> DataFrame:
    """``(group, draw, item)``: ``m`` independent draws with replacement per group, numbered from 0."""
    tops = _packed(tables.select(group, "__chunk", "mass"), [group], "__chunk", "mass")
    blocks = tops.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, (m - 1) // BLOCK)).cast("long"))))
    first = F.col("__b") * BLOCK
    ids = F.when(first < m, F.sequence(first, F.least(first + BLOCK, F.lit(m).cast("long")) - 1)) if m > 0 else F.array().cast("array<long>")

    def chunk_of(j):
        u = u01(seed, F.lit("alias-chunk"), F.coalesce(F.col(group).cast("string"), F.lit("")), j)
        return F.struct(j.alias("j"), _pick(F.col("values"), F.col("keep"), F.col("other"), u).alias("c"))

    drawn = blocks.select(F.col(group).alias("__g"), F.explode(F.transform(ids, chunk_of)).alias("d")).select("__g", "d.j", "d.c")
    hit = drawn.join(tables, F.col("__g").eqNullSafe(F.col(group)) & (F.col("c") == F.col("__chunk")))
    u = u01(seed, F.lit("alias"), F.coalesce(F.col(group).cast("string"), F.lit("")), F.col("j"))
    return hit.select(group, F.col("j").alias(out), _pick(F.col("values"), F.col("keep"), F.col("other"), u).alias(item))
