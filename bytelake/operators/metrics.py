"""Metric histories: per-episode metrics, log points, long-form series for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RewardConfig

CFG = RewardConfig()


def metrics_history(plan: DataFrame, sums: DataFrame, key: str = "pair_id", cfg: RewardConfig = CFG) -> DataFrame:
    """Per episode: scale, ``-sum(logp * reward)`` and mean reward on the common prefix, lengths.

    ``sums`` (:func:`bytelake.operators.aligned.episode_sums`) holds one narrow row a sequence with all that does not depend on the scale;
    each episode only adds the end penalty: ``loss = -(weighted + last_logp * penalty)``, ``avg = (base_total + penalty) / n``.
    """
    f = sums.select(key, "gen_len", "ref_len", "weighted", "last_logp", "base_total")
    h = plan.join(f, key)
    g, r = F.col("gen_len"), F.col("ref_len")
    n = F.least(g, r)
    pen = F.when(g < r, F.lit(cfg.base_penalty) * F.col("penalty_scale") * (r - g) / r).otherwise(F.lit(0.0))
    return h.select(
        (F.col("episode") + 1).alias("episode"),
        "penalty_scale",
        F.when(n > 0, -(F.col("weighted") + F.col("last_logp") * pen)).otherwise(F.lit(0.0)).alias("policy_loss"),
        F.when(n > 0, (F.col("base_total") + pen) / n).otherwise(F.lit(0.0)).alias("avg_reward"),
        g.cast("long").alias("gen_len"),
        r.cast("long").alias("ref_len"),
    )


def metrics_log_points(history: DataFrame, log_every: int = 5, save_every: int = 20) -> DataFrame:
    """Rows logged every ``log_every`` episodes (1-based), flagged when a snapshot is also saved."""
    return history.where(F.col("episode") % log_every == 0).withColumn("save_point", F.col("episode") % save_every == 0)


def metrics_series(history: DataFrame, metric_cols: list[str], episode: str = "episode") -> DataFrame:
    """Long form ``(episode, metric, value)``; empty when fewer than two episodes exist."""
    n = history.agg(F.count(F.lit(1))).scalar()
    long = history.unpivot([episode], metric_cols, "metric", "value")
    return long.where(n >= 2)
