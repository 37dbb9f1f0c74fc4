"""Exact global row index without a single-partition window.

Rows are cut into ``buckets`` ranges that are monotone in the sort order, counted per bucket
(partial aggregation, one row per bucket), the bucket counts are turned into start offsets on
that tiny table, and each row's index is ``offset + row_number()`` inside its bucket.  Only the
bucket table (bounded by ``buckets`` rows) is broadcast; rows are never gathered into one task.

Bucket assignment:
* ``uniform_col`` given (a column known to be uniform on [0, 1) and first in the order, such as
  :func:`bytelake.functions.rng.u01`): ``floor(u * buckets)`` — no sampling at all;
* otherwise: range partitions of the order columns.  Rows are sorted inside their partition and numbered or summed as they stream by,
  the table is written once (so that totals and rows see the same partitions), and partition totals become offsets.  No key
  reaches the driver.

Running values per group cut each group at boundary keys of the first order column (64 buckets, a bounded sample read to the driver).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def default_buckets(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(64, 4 * n)


def _binary_search_bucket(k: Column, bounds: Column, nb: int) -> Column:
    """Number of elements of the ascending array ``bounds`` (length ``nb``) that are <= ``k``."""
    steps = int(math.ceil(math.log2(nb + 1))) + 1
    init = F.struct(F.lit(0).alias("lo"), F.lit(nb).alias("hi"))

    def step(acc, _i):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        right = F.element_at(bounds, mid + 1) <= k
        return (
            F.when(lo >= hi, acc)
            .when(right, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])


def _bucketed(df: DataFrame, order_cols: list[str], buckets: int | None, uniform_col: str | None) -> DataFrame:
    nb = buckets or default_buckets(df)
    if uniform_col is not None:
        if uniform_col != order_cols[0]:
            raise ValueError("uniform_col must be the first order column")
        return df.withColumn("__bkt", F.least(F.floor(F.col(uniform_col) * nb).cast("int"), F.lit(nb - 1)))
    raise ValueError("buckets need a uniform column")


def _by_range(df: DataFrame, order_cols: list[str], value: Column, out: str, buckets: int) -> DataFrame:
    """Exclusive sums over range partitions of the order columns."""
    x = df.withColumn("__v", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    at = x.columns.index("__v")
    names = [*x.columns, "__part", "__run"]

    def run(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            v = batch.column(at).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(v)
            total = int(sums[-1]) if len(v) else total
            own = pa.array(np.full(len(v), part, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, own, pa.array(sums - v)], names=names)

    keys = [F.col(c) for c in order_cols]
    ranged = x.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
    summed = cut_lineage(ranged.mapInArrow(run, x.schema.add("__part", "long").add("__run", "long")))
    totals = summed.groupBy("__part").agg(F.sum("__v").alias("__n"))
    # tiny table (one row a partition): a global window here is a single small task by design
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__part", F.coalesce(before, F.lit(0)).alias("__off"))
    return summed.join(F.broadcast(offsets), "__part").withColumn(out, (F.col("__off") + F.col("__run")).cast("long")).drop("__part", "__run", "__v", "__off")


def _by_bounds(df: DataFrame, first: str, nb: int) -> DataFrame:
    """Adds ``__bkt``, monotone in ``first`` (nulls first, as in an ascending sort)."""
    keys = df.select(first).where(F.col(first).isNotNull())
    n = keys.count()
    kept = keys.sample(False, min(1.0, 64.0 * nb / max(n, 1)), 7).orderBy(first).collect()
    cuts = sorted({i * len(kept) // nb for i in range(1, nb)} - {0})
    bounds = [kept[i][0] for i in cuts if i < len(kept)]
    if not bounds:
        return df.withColumn("__bkt", F.lit(0))
    kind = df.schema[first].dataType
    array = F.array(*[F.lit(v).cast(kind) for v in bounds])
    return df.withColumn("__bkt", _binary_search_bucket(F.col(first), array, len(bounds)))


def _exclusive_prefix(
    df: DataFrame, order_cols: list[str], value: Column, out: str, buckets: int | None, uniform_col: str | None
) -> DataFrame:
    if uniform_col is None:
        return _by_range(df, order_cols, value, out, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    tagged = _bucketed(df, order_cols, buckets, uniform_col).withColumn("__v", value)
    totals = tagged.groupBy("__bkt").agg(F.sum("__v").alias("__n"))
    # tiny table (<= buckets rows): a global window here is a single small task by design
    offsets = totals.select(
        "__bkt",
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
    )
    w = Window.partitionBy("__bkt").orderBy(*[F.col(c) for c in order_cols]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        tagged.join(F.broadcast(offsets), "__bkt")
        .withColumn(out, (F.col("__off") + F.coalesce(F.sum("__v").over(w), F.lit(0))).cast("long"))
        .drop("__bkt", "__off", "__v")
    )


def with_row_index(
    df: DataFrame,
    order_cols: list[str],
    out: str = "idx",
    buckets: int | None = None,
    uniform_col: str | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ascending ``order_cols`` (must be unique)."""
    return _exclusive_prefix(df, order_cols, F.lit(1).cast("long"), out, buckets, uniform_col)


def with_exclusive_sum(
    df: DataFrame,
    order_cols: list[str],
    value: Column,
    out: str,
    buckets: int | None = None,
    uniform_col: str | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows strictly before this one in ``order_cols`` order."""
    return _exclusive_prefix(df, order_cols, value, out, buckets, uniform_col)


def with_running_agg_by_group(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str],
    value: str,
    out: str,
    agg: str = "min",
    buckets: int = 64,
) -> DataFrame:
    """Add ``out`` = ``agg`` (``min`` or ``sum``) of ``value`` over the rows strictly before this one
    within its group (``order_cols`` ascending, unique within a group); null for a group's first row.

    A group never lands in one task: rows are cut into ``buckets`` ranges of the first order column (one
    set of boundaries, in which a hot group weighs by its rows), bucket aggregates are turned into exclusive running
    values over at most ``buckets`` rows per group, and combined with the running value inside each bucket.
    """
    fn = {"min": F.min, "sum": F.sum}[agg]
    tagged = _by_bounds(df, order_cols[0], buckets)
    parts = tagged.groupBy(*group_cols, "__bkt").agg(fn(value).alias("__rk_m"))
    wb = Window.partitionBy(*group_cols).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select(*group_cols, "__bkt", fn("__rk_m").over(wb).alias("__rk_before"))
    wi = Window.partitionBy(*group_cols, "__bkt").orderBy(*[F.col(c) for c in order_cols]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    inner = fn(value).over(wi)
    if agg == "min":
        combined = F.least(F.col("__rk_before"), inner)
    else:
        combined = F.when(F.col("__rk_before").isNull() & inner.isNull(), F.lit(None)).otherwise(
            F.coalesce(F.col("__rk_before"), F.lit(0)) + F.coalesce(inner, F.lit(0))
        )
    return tagged.join(offs, group_cols + ["__bkt"]).withColumn(out, combined).drop("__bkt", "__rk_before")


def with_running_min_by_group(df: DataFrame, group_cols: list[str], order_cols: list[str], value: str, out: str, buckets: int = 64) -> DataFrame:
    """Running minimum of earlier rows per group (see :func:`with_running_agg_by_group`)."""
    return with_running_agg_by_group(df, group_cols, order_cols, value, out, "min", buckets)
