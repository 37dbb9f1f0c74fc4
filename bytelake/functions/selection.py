"""Order statistics of a table by selection: bucket counts, then refinement of the buckets that hold the wanted ranks.

The order is ``(u, key)`` with ``u`` uniform on [0, 1), such as :func:`bytelake.functions.rng.u01`.  Each level cuts a bucket into
``WIDTH`` parts and counts them (partial aggregation, at most ``WIDTH`` rows a wanted rank); only the parts that hold a wanted rank are read on,
so after two levels about ``n / 2^24`` narrow rows are ordered.  The result is one row that the caller compares rows with: no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096
LEVELS = 2


def _part(level: int) -> Column:
    return F.floor(F.col("u") * float(WIDTH**level)).cast("long")


def order_statistics(df: DataFrame, u: Column, key: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """One row ``cuts`` with fields ``r0, r1, ...``: the ``(u, key)`` structs at the 0-based ranks that ``ranks(n)`` gives for ``n`` rows; null where
    a rank is not below ``n``.  Keys should be unique (equal rows are on one side of a cut)."""
    narrow = df.select(u.alias("u"), F.col(key).alias("key"))
    fields = [f"t{i}" for i in range(len(ranks(F.lit(0))))]
    found = None  # one row: per rank the part that holds it and the rank inside that part
    for level in range(1, LEVELS + 1):
        rows = narrow if found is None else _inside(narrow, found, fields, level - 1)
        # a bounded table: WIDTH parts a wanted rank
        parts = rows.groupBy(_part(level).alias("part"), *([] if found is None else ["t"])).agg(F.count(F.lit(1)).alias("size"))
        parts = parts.withColumn("above", F.floor(F.col("part") / WIDTH))
        of_part = Window.partitionBy("above")
        before = F.sum("size").over(of_part.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
        if found is None:
            parts = parts.withColumn("n", F.sum("size").over(of_part))
            rest = [r.cast("long") - F.col("before") for r in ranks(F.col("n"))]
            hit = [(x >= 0) & (x < F.col("size")) for x in rest]
        else:
            rest = [F.col(f"t.{f}.rest") - F.col("before") for f in fields]
            hit = [(F.col("above") == F.col(f"t.{f}.part")) & (x >= 0) & (x < F.col("size")) for f, x in zip(fields, rest, strict=True)]
        place = [F.max(F.when(h, F.struct("part", x.alias("rest")))).alias(f) for f, h, x in zip(fields, hit, rest, strict=True)]
        found = parts.agg(*place).select(F.struct(*fields).alias("t"))
    rows = _inside(narrow, found, fields, LEVELS).withColumn("part", _part(LEVELS))
    at = F.row_number().over(Window.partitionBy("part").orderBy("u", "key")) - 1
    rows = rows.select("t", "part", F.struct("u", "key").alias("row"), at.cast("long").alias("at"))
    here = [(F.col("part") == F.col(f"t.{f}.part")) & (F.col("at") == F.col(f"t.{f}.rest")) for f in fields]
    cuts = rows.agg(*[F.max(F.when(h, F.col("row"))).alias(f"r{i}") for i, h in enumerate(here)])
    return cuts.select(F.struct(*cuts.columns).alias("cuts"))


def _inside(narrow: DataFrame, found: DataFrame, fields: list[str], level: int) -> DataFrame:
    """The rows in the parts that hold a wanted rank, with those parts as ``t``."""
    any_of = F.lit(False)
    for f in fields:
        any_of = any_of | F.coalesce(_part(level) == F.col(f"t.{f}.part"), F.lit(False))
    return narrow.withColumn("t", found.scalar()).where(any_of)


def with_cuts(df: DataFrame, u: Column, key: str, ranks: Callable[[Column], list[Column]], label: Callable[[Callable[[int], Column]], Column], out: str) -> DataFrame:
    """Adds ``out = label(before)``, where ``before(i)`` tells whether a row comes before the i-th wanted order statistic (all rows do where its
    rank is not below the number of rows).  Each row is compared with the cuts where it is read."""
    cuts = order_statistics(df, u, key, ranks).scalar()
    held = df.withColumn("__cuts", cuts).withColumn("__row", F.struct(u.alias("u"), F.col(key).alias("key")))

    def before(i: int) -> Column:
        return F.col(f"__cuts.r{i}").isNull() | (F.col("__row") < F.col(f"__cuts.r{i}"))

    return held.withColumn(out, label(before)).drop("__cuts", "__row")
