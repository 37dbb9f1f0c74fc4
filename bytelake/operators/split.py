"""Seeded, partition-independent splits and samples.

All draws use ``u01(seed, <operator>, key)``, so draws of different operators are independent.  Exact-size splits find the order statistics of that
draw at the cuts by selection and compare each row with them: sizes are exact, and no row is shuffled or ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import bloom_filter, may_contain
from ..functions.rank import with_row_index
from ..functions.rng import u01
from ..functions.selection import with_cuts


def shuffle_rows(df: DataFrame, key: str, seed: int = 42, out: str = "pos", purpose: str = "shuffle") -> DataFrame:
    """Seeded permutation: ``out`` is the 0-based position of each row; ``purpose`` names the draw."""
    return with_row_index(df.withColumn("__u", u01(seed, F.lit(purpose), key)), ["__u", key], out, uniform_col="__u").drop("__u")


def _n_rows(df: DataFrame):
    return df.agg(F.count(F.lit(1))).scalar()


def split_three_way(df: DataFrame, key: str, holdout: float = 0.2, test_of_holdout: float = 0.5, seed: int = 42) -> DataFrame:
    """Exact train/val/test: ``ceil(holdout*n)`` held out, of which ``ceil(test_of_holdout*h)`` are test."""
    def cuts(n):
        n_hold = F.ceil(F.lit(float(holdout)) * n)
        return [n - n_hold, n - F.ceil(F.lit(float(test_of_holdout)) * n_hold)]

    u = u01(seed, F.lit("split3"), key)
    return with_cuts(df, u, key, cuts, lambda before: F.when(before(0), "train").when(before(1), "val").otherwise("test"), "split")


def split_two_way(df: DataFrame, key: str, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """Exact train/val with ``ceil(frac*n)`` validation rows."""
    u = u01(seed, F.lit("split2"), key)
    cuts = lambda n: [n - F.ceil(F.lit(float(frac)) * n)]
    return with_cuts(df, u, key, cuts, lambda before: F.when(before(0), "train").otherwise("val"), "split")


def split_hash(df: DataFrame, key: str, weights=(0.8, 0.1, 0.1), names=("train", "val", "test"), seed: int = 42) -> DataFrame:
    """Threshold split on ``u01``: no shuffle, stable under appends, usable on streams; sizes approximate."""
    total = float(sum(weights))
    u = u01(seed, F.lit("split_hash"), key)
    expr, acc = None, 0.0
    for w, name in zip(weights[:-1], names[:-1]):
        acc += w / total
        expr = (F.when(u < acc, name) if expr is None else expr.when(u < acc, name))
    return df.withColumn("split", expr.otherwise(names[-1]))


def split_fraction_independent(df: DataFrame, key: str, frac_a: float = 0.9, frac_b: float = 0.1, seed_a: int = 42, seed_b: int | None = None):
    """Two Bernoulli samples drawn separately (they may overlap).

    With one seed for both (the default) the smaller sample is nested in the larger, which is what
    drawing both samples from the same frame with one seed gives; pass ``seed_b`` for independent draws.
    """
    seed_b = seed_a if seed_b is None else seed_b
    a = df.where(u01(seed_a, F.lit("fraction"), key) < frac_a)
    b = df.where(u01(seed_b, F.lit("fraction"), key) < frac_b)
    return a, b


def split_leak_check(a: DataFrame, b: DataFrame, key: str, text_col: str) -> DataFrame:
    """One row: sizes and how many rows of ``b`` also occur in ``a`` by key and by exact text.

    Text is matched on its SHA-256, so no text is shuffled; both build sides are de-duplicated (a text repeated many
    times is one build row).  Keys and digests of ``b`` fill two Bloom filters of fixed size; only the rows of ``a`` that pass them are shuffled
    for the exact joins, so what moves of ``a`` falls with the overlap.
    """
    digest = F.unhex(F.sha2(F.col(text_col), 256))
    sides = [(F.col(key), "__k"), (digest, "__t")]
    ka, ta = (
        may_contain(a.select(v.alias("__v")), F.col("__v"), bloom_filter(b.select(v.alias("__v")), F.col("__v"))).distinct().select(F.col("__v").alias(n), F.lit(True).alias(n + "in"))
        for v, n in sides
    )
    bb = b.select(F.col(key).alias("__k"), digest.alias("__t")).join(ka, "__k", "left").join(ta, "__t", "left")
    found = bb.agg(
        F.count(F.lit(1)).alias("n_b"), F.count("__kin").alias("key_overlap"), F.count("__tin").alias("text_overlap"),
        F.count(F.when(F.col("__kin").isNull(), 1)).alias("key_only_b"),
    )
    return found.select(_n_rows(a).alias("n_a"), "n_b", "key_overlap", "text_overlap", "key_only_b")


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))


ONE_TASK = 10_000  # rows that one task may order


def sample_fixed_n(df: DataFrame, key: str, n: int, seed: int = 42, oversample: float = 4.0, one_task: int = ONE_TASK) -> DataFrame:
    """``n`` rows without replacement (the whole table when n >= size): the ``n`` smallest ``u01`` draws.

    Up to ``one_task`` rows: rows with ``u01 < t`` (``t`` sized for about ``oversample * n`` rows) are counted; when at least
    ``n`` fall below ``t`` the answer lies among them and only they are ordered, otherwise every row is.  Beyond, the n-th order
    statistic is found by selection and rows are compared with it where they are read, so no task ever holds the sample.
    """
    u = u01(seed, F.lit("sample"), key)
    if n > one_task:
        return with_cuts(df, u, key, lambda _: [F.lit(n)], lambda before: before(0), "__in").where("__in").drop("__in")
    x = df.withColumn("__u", u)
    total = _n_rows(df)
    t = F.least(F.lit(1.0), F.lit(float(n * oversample + 64)) / F.greatest(total, F.lit(1)))
    below = x.where(F.col("__u") < t).agg(F.count(F.lit(1))).scalar()
    cut = F.when(below >= n, t).otherwise(F.lit(2.0))
    return x.where(F.col("__u") < cut).orderBy("__u", key).limit(n).drop("__u")


def draw_with_replacement(df: DataFrame, key: str, m: int, seed: int = 42, out: str = "draw") -> DataFrame:
    """``m`` draws with replacement (a training batch): draw j picks row ``floor(u01(seed, "draw", j) * N)``.

    Only keys are indexed (distributed rank); the ``m`` drawn keys then meet the rows where they are read (up to a million
    draws, beyond by a shuffle), so rows are not moved to be numbered.
    """
    keys = with_row_index(df.select(key), [key], "__idx")
    n = _n_rows(keys)
    draws = df.sparkSession.range(m).select(
        F.col("id").alias(out), F.floor(u01(seed, F.lit("draw"), "id") * n).cast("long").alias("__idx")
    )
    small = F.broadcast if m <= 1_000_000 else (lambda x: x)
    chosen = keys.join(small(draws), "__idx").select(out, key)
    return df.join(small(chosen), key).select(out, *df.columns)


def episode_plan(
    pairs: DataFrame,
    key: str,
    episodes: int = 100,
    n_pairs: int = 5,
    log_every: int = 5,
    save_every: int = 20,
    max_scale: float = 2.5,
    seed: int = 42,
) -> DataFrame:
    """Per episode: the selected pair, its penalty scale and the log/save flags.

    ``n_pairs`` pairs are sampled once; each episode draws one of them with a keyed draw.
    The sampled set is bounded by ``n_pairs`` rows, so it is broadcast.
    """
    chosen = sample_fixed_n(pairs, key, n_pairs, seed)
    chosen = with_row_index(chosen.withColumn("__u", u01(seed, F.lit("sample"), key)), ["__u", key], "slot", buckets=1, uniform_col="__u").drop("__u")
    k = _n_rows(chosen)
    e = F.col("id")
    plan = pairs.sparkSession.range(episodes).select(
        e.cast("int").alias("episode"),
        F.floor(u01(seed, F.lit("episode"), e) * k).cast("long").alias("slot"),
        (F.lit(1.0) + e / F.greatest(F.lit(1), F.lit(episodes - 1)) * F.lit(max_scale - 1.0)).alias("penalty_scale"),
        ((e + 1) % log_every == 0).alias("log_point"),
        ((e + 1) % save_every == 0).alias("save_point"),
    )
    return plan.join(F.broadcast(chosen), "slot").drop("slot")
