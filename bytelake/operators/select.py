"""Candidate selection: accept/reject, rerank, reward-weighted probabilities, scale sweep.

Groups are prompts.  No operator orders or gathers a whole prompt in one task: per-prompt
totals come from partial aggregations joined back (adaptive skew joins split hot prompts), and
the top-k is taken per (prompt, salt) first so the final per-prompt ordering sees at most
``k * salts`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RewardConfig
from .rewards import total_reward, with_scales


def accept_reject(scored: DataFrame, threshold: float, key: str = "pair_id") -> DataFrame:
    """Accept a candidate when ``total_reward >= threshold`` or it is at least as long as the target."""
    acc = (F.col("total_reward") >= threshold) | (F.col("gen_len") >= F.col("ref_len"))
    return scored.withColumn("accepted", acc)


def accept_rate(flagged: DataFrame, key: str = "pair_id") -> DataFrame:
    return flagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_cands"),
        F.count_if("accepted").alias("n_accepted"),
        (F.count_if("accepted") / F.count(F.lit(1))).alias("accept_rate"),
    )


def rerank_top_k(scored: DataFrame, k: int, key: str = "pair_id", score: str = "score", tie: str = "cand", salts: int = 16) -> DataFrame:
    """Keep the ``k`` best candidates per prompt by ``score`` (ties: ``tie`` ascending).

    Two stages: top-k within ``(prompt, hash(tie) % salts)``, then top-k of those survivors.
    """
    order = [F.col(score).desc(), F.col(tie).asc()]
    salted = scored.withColumn("__salt", F.pmod(F.xxhash64(F.col(tie)), F.lit(salts)))
    first = salted.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*order)))
    first = first.where(F.col("__r") <= k).drop("__r", "__salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def reward_weighted_probs(scored: DataFrame, key: str = "pair_id", logp: str = "model_score", reward: str = "total_reward") -> DataFrame:
    """``p * exp(reward)`` renormalised per prompt: a max-shifted softmax of ``logp + reward`` whose
    per-prompt max and normaliser come from aggregations joined back."""
    x = scored.withColumn("__z", F.col(logp) + F.col(reward))
    mx = x.groupBy(key).agg(F.max("__z").alias("__m"))
    x = x.join(mx, key).withColumn("__e", F.exp(F.col("__z") - F.col("__m")))
    tot = x.groupBy(key).agg(F.sum("__e").alias("__s"))
    return x.join(tot, key).withColumn("prob", F.col("__e") / F.col("__s")).drop("__z", "__m", "__e", "__s")


def scale_sweep(scored: DataFrame, scales, key: str = "pair_id", cfg: RewardConfig = RewardConfig()) -> DataFrame:
    """Per penalty scale: accepted candidates (total >= 0), mean total, prompts whose best is the model's."""
    t = total_reward(with_scales(scored.drop("scale") if "scale" in scored.columns else scored, scales), "scale", cfg)
    best = t.groupBy(key, "scale").agg(F.max_by("cand", F.struct("total_reward", F.col("cand"))).alias("best"))
    per = t.groupBy("scale").agg(
        F.count_if(F.col("total_reward") >= 0).alias("n_accepted"), F.avg("total_reward").alias("avg_total")
    )
    b = best.groupBy("scale").agg(F.count_if(F.col("best") == "model").alias("n_best_model"))
    return per.join(b, "scale")
