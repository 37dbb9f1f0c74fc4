"""Nucleus (top-p) filtering and seeded categorical draws.

``top_p_filter`` never puts a whole group in one task: group totals and per-group mass buckets
come from partial aggregations, rows whose whole bucket lies before the cut are kept and rows
whose bucket starts after it are dropped without ordering; in the single boundary bucket of each group
the distinct weights are ordered, and equal weights at the cut are ranked by bucketed counts.
Joins on group keys are shuffle joins that adaptive execution splits when a group is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import with_running_agg_by_group
from ..functions.rng import u01
from ..session import cut_lineage

ZERO_BUCKET = 1 << 30


def top_p_filter(df: DataFrame, group: str, item: str, weight: str, p: float, resolutions=(64, 65536)) -> DataFrame:
    """Per group, sort by weight desc (ties: item asc) and keep items whose *preceding* cumulative
    share is <= ``p`` (so at least one); ``prob`` is the share renormalised over the kept items
    (input columns named ``share``/``prob`` are replaced).

    Cumulative sums are taken in weight units and compared with ``p * group_total``, so integer
    weights (counts) give exact decisions at the cut.  Each level of ``resolutions`` (log-scale
    buckets per octave, each level nested in the previous) keeps whole buckets before the cut,
    drops buckets after it, and passes only the boundary bucket on; in the last one the distinct weights are
    ordered, and a run of equal weights at the cut is ranked by bucketed counts.
    """
    # the input is read by several branches below: write it once
    df = cut_lineage(df)
    totals = df.groupBy(group).agg(F.sum(weight).alias("__tot"))
    cand = (
        df.join(totals, group)
        .withColumn("__w", F.col(weight))
        .withColumn("__share", F.col(weight) / F.col("__tot"))
        .withColumn("__base", F.lit(0).cast(df.schema[weight].dataType))
    )
    cut = F.lit(float(p)) * F.col("__tot")
    kept_parts, mass_parts = [], []
    for level, res in enumerate(resolutions):
        b = F.when(F.col("__share") > 0, F.floor(-F.log2(F.col("__share")) * res)).otherwise(F.lit(ZERO_BUCKET)).cast("long")
        cand = cand.withColumn("__b", b)
        bt = cand.groupBy(group, "__b").agg(F.sum("__w").alias("__bm"), F.first("__base").alias("__b0"), F.first("__tot").alias("__t"))
        wb = Window.partitionBy(group).orderBy("__b")  # bounded: buckets of one group at this level
        bt = bt.withColumn(
            "__start", F.col("__b0") + F.coalesce(F.sum("__bm").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).withColumn("__end", F.col("__start") + F.col("__bm"))
        bcut = F.lit(float(p)) * F.col("__t")
        # whole buckets kept at this level contribute their mass without touching their rows
        mass_parts.append(bt.where(F.col("__end") <= bcut).select(group, F.col("__bm").alias("__m")))
        sel = bt.select(group, "__b", "__start", "__end")
        y = cand.join(sel, [group, "__b"])
        kept_parts.append(y.where(F.col("__end") <= cut).select(*df.columns, "__w", "__share"))
        # boundary rows only go on to the next level
        cand = (
            y.where((F.col("__start") <= cut) & (F.col("__end") > cut))
            .withColumn("__base", F.col("__start"))
            .drop("__b", "__start", "__end")
        )
    # boundary bucket: equal weights are one class; only the class at the cut needs its items in order
    one = F.lit(1).cast("long")
    classes = cand.groupBy(group, "__w").agg(F.count(F.lit(1)).alias("__n"), F.first("__base").alias("__b0"))
    wc = Window.partitionBy(group).orderBy(F.col("__w").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum(F.col("__n") * F.col("__w")).over(wc), F.lit(0))
    classes = classes.withColumn("__prec", F.col("__b0") + above).drop("__b0")
    edge = cand.join(classes, [group, "__w"]).where(F.col("__prec") <= cut).withColumn("__one", one)
    whole = F.col("__prec") + (F.col("__n") - 1) * F.col("__w") <= cut
    edge = cut_lineage(edge.withColumn("__whole", whole))
    tied = with_running_agg_by_group(edge.where("NOT __whole"), [group, "__w"], [item], "__one", "__rank", "sum")
    tied = tied.where(F.col("__prec") + F.coalesce(F.col("__rank"), F.lit(0)) * F.col("__w") <= cut)
    edge = edge.where("__whole").unionByName(tied.drop("__rank")).select(*df.columns, "__w", "__share")
    kept_parts.append(edge)
    mass_parts.append(edge.select(group, F.col("__w").alias("__m")))
    mass = mass_parts[0]
    for part in mass_parts[1:]:
        mass = mass.unionByName(part)
    mass = mass.groupBy(group).agg(F.sum("__m").alias("__kept"))
    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.unionByName(part)
    return kept.join(mass, group).select(
        *[c for c in df.columns if c not in ("share", "prob")],
        F.col("__share").alias("share"),
        (F.col("__w") / F.col("__kept")).alias("prob"),
    )


def sample_categorical(df: DataFrame, group: str, item: str, prob: str, seed: int = 42) -> DataFrame:
    """One seeded draw per group by inverse CDF over items in ascending order.

    The cumulative mass is a bucketed running sum per group (no group is ordered in one task);
    the drawn item is the first whose cumulative mass exceeds ``u01(seed, "categorical", group) * total``.
    """
    tot = df.groupBy(group).agg(F.sum(prob).alias("__tot"))
    x = with_running_agg_by_group(df, [group], [item], prob, "__prev_mass", "sum")
    x = x.withColumn("__cum", F.coalesce(F.col("__prev_mass"), F.lit(0.0)) + F.col(prob)).join(tot, group)
    hit = x.where(F.col("__cum") > u01(seed, F.lit("categorical"), group) * F.col("__tot"))
    return hit.groupBy(group).agg(F.min_by(item, "__cum").alias(item))


def sample_top_p(df: DataFrame, group: str, item: str, weight: str, p: float, seed: int = 42) -> DataFrame:
    """Top-p filter, then one draw per group from the renormalised kept items."""
    return sample_categorical(top_p_filter(df, group, item, weight, p), group, item, "prob", seed)


def token_logprob(chosen: DataFrame, model: DataFrame, group: str = "ctx", item: str = "next") -> DataFrame:
    """Log-probability of each chosen token under the model (equi-join on ``(ctx, token)``)."""
    m = model.select(group, item, F.log("prob").alias("logp"))
    return chosen.join(m, [group, item], "left")
