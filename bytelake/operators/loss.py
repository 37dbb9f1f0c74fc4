"""Loss tables over the counted next-byte model.

Evaluation data is first aggregated to ``(…, ctx, next, cnt)`` so each distinct transition is
scored once.  The model has at most ``256^(k+1)`` rows; it is broadcast only while that bound is
at most ``MAX_BROADCAST_ROWS``, otherwise the join shuffles on ``(ctx, next)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PAD, VOCAB, WeightConfig

MAX_BROADCAST_ROWS = 1 << 20
INF = float("inf")


def _model_side(model: DataFrame, k: int) -> DataFrame:
    m = model.select("ctx", "next", F.col("prob").alias("__p"))
    return F.broadcast(m) if VOCAB ** (k + 1) <= MAX_BROADCAST_ROWS else m


def score_transitions(data: DataFrame, model: DataFrame, k: int = 1, unseen_ctx_prob: float = 1.0 / VOCAB, dense: bool = True) -> DataFrame:
    """Attach ``nll = -ln p(next | ctx)`` to aggregated transitions; masked targets (next == 0) dropped.

    ``p = 0`` gives ``+inf``; a context absent from the model gets ``unseen_ctx_prob``.  A dense
    model (every seen context lists all 256 next bytes) is read once: a missing row can only mean
    an unseen context.  A sparse model needs its context list as a second input.
    """
    d = data.where(F.col("next") != PAD)
    j = d.join(_model_side(model, k), ["ctx", "next"], "left")
    if dense:
        p = F.coalesce(F.col("__p"), F.lit(float(unseen_ctx_prob)))
        return j.withColumn("nll", F.when(p > 0, -F.log(p)).otherwise(F.lit(INF))).drop("__p")
    ctx_seen = model.select("ctx").distinct().withColumn("__seen", F.lit(True))
    ctx_side = F.broadcast(ctx_seen) if VOCAB**k <= MAX_BROADCAST_ROWS else ctx_seen
    j = j.join(ctx_side, "ctx", "left")
    p = F.when(F.col("__seen").isNull(), F.lit(float(unseen_ctx_prob))).otherwise(F.coalesce(F.col("__p"), F.lit(0.0)))
    return j.withColumn("nll", F.when(p > 0, -F.log(p)).otherwise(F.lit(INF))).drop("__p", "__seen")


def cross_entropy_masked(data: DataFrame, model: DataFrame, group=(), k: int = 1, unseen_ctx_prob: float = 1.0 / VOCAB) -> DataFrame:
    """Mean ``-ln p(target)`` over unmasked targets, divided by ``n + 1e-9`` (per group if given)."""
    s = score_transitions(data, model, k, unseen_ctx_prob)
    n = F.sum("cnt")
    return s.groupBy(*group).agg(
        n.cast("long").alias("n_tokens"),
        (F.coalesce(F.sum(F.col("cnt") * F.col("nll")), F.lit(0.0)) / (F.coalesce(n, F.lit(0)) + F.lit(1e-9))).alias("ce"),
    )


def weighted_cross_entropy(data: DataFrame, model: DataFrame, weights: DataFrame, kl_lambda: float = WeightConfig.kl_lambda, group=(), k: int = 1) -> DataFrame:
    """CE, CE weighted by ``weight[target]`` (both over the mask count), proxy ``|wce-ce|``, total ``wce + lambda*proxy``."""
    s = score_transitions(data, model, k)
    w = F.broadcast(weights.select(F.col("byte").alias("next"), "weight"))  # 256 rows
    s = s.join(w, "next", "left")
    m = F.coalesce(F.sum("cnt"), F.lit(0)) + F.lit(1e-9)
    out = s.groupBy(*group).agg(
        F.sum("cnt").cast("long").alias("n_tokens"),
        (F.sum(F.col("cnt") * F.col("nll")) / m).alias("ce"),
        (F.sum(F.col("cnt") * F.col("nll") * F.col("weight")) / m).alias("wce"),
    )
    return out.withColumn("proxy", F.abs(F.col("wce") - F.col("ce"))).withColumn(
        "total", F.col("wce") + F.lit(float(kl_lambda)) * F.col("proxy")
    )


def eval_loss_mean(losses: DataFrame, split_col: str = "split", loss_col: str = "loss") -> DataFrame:
    """Per split: mean over evaluation batches."""
    return losses.groupBy(split_col).agg(F.avg(loss_col).alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def eval_loss_robust(losses: DataFrame, split_col: str = "split", loss_col: str = "loss") -> DataFrame:
    """Per split: lower median of the finite batch losses; ``inf`` when none is finite."""
    from ..functions.rank import with_running_agg_by_group

    finite = F.col(loss_col) < F.lit(INF)
    counts = losses.where(finite).groupBy(split_col, loss_col).agg(F.count(F.lit(1)).alias("__n"))
    totals = losses.groupBy(split_col).agg(F.count(F.when(finite, 1)).alias("n_finite"), F.count(F.lit(1)).alias("n_batches"))
    # the lower median is the first value by which half of the finite losses are counted
    below = with_running_agg_by_group(counts, [split_col], [loss_col], "__n", "__before", "sum")
    upto = F.coalesce(F.col("__before"), F.lit(0)) + F.col("__n")
    median = below.join(totals, split_col).where(2 * upto >= F.col("n_finite")).groupBy(split_col).agg(F.min(loss_col).alias("loss"))
    return totals.join(median, split_col, "left").select(split_col, F.coalesce("loss", F.lit(INF)).alias("loss"), "n_finite", "n_batches")


def best_so_far(history: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Running strict minimum per run; ``new_best`` when the value beats every earlier one.

    The minimum of earlier steps is a bucketed prefix aggregate, so a long run is not one task.
    """
    from ..functions.rank import with_running_min_by_group

    return with_running_min_by_group(history, [run], [step], value, "__prev").select(
        *history.columns,
        (F.col("__prev").isNull() | (F.col(value) < F.col("__prev"))).alias("new_best"),
        F.when(F.col("__prev").isNull(), F.col(value)).otherwise(F.least(F.col(value), F.col("__prev"))).alias("best"),
    )


def kl_between(policy: DataFrame, ref: DataFrame, coef: float = 0.1, direction: str = "ref_policy", k: int = 1) -> DataFrame:
    """Mean over shared contexts of the KL between two next-byte tables, times ``coef``.

    ``direction='ref_policy'`` computes ``sum(ref * (ln ref - ln policy))`` — the formula the
    reference evaluates; ``'policy_ref'`` swaps the roles.
    """
    p = policy.select("ctx", "next", F.col("prob").alias("__p"))
    q = ref.select("ctx", "next", F.col("prob").alias("__q"))
    if VOCAB ** (k + 1) <= MAX_BROADCAST_ROWS:
        q = F.broadcast(q)
    a, b = ("__q", "__p") if direction == "ref_policy" else ("__p", "__q")
    j = p.join(q, ["ctx", "next"])
    per_ctx = j.groupBy("ctx").agg(F.sum(F.col(a) * (F.log(F.col(a)) - F.log(F.col(b)))).alias("kl"))
    return per_ctx.agg(
        F.count(F.lit(1)).alias("n_ctx"),
        F.avg("kl").alias("kl_mean"),
        (F.avg("kl") * F.lit(float(coef))).alias("kl_penalty"),
    )


def doc_perplexity(doc_counts: DataFrame, model: DataFrame, key: str = "doc_id", k: int = 1) -> DataFrame:
    """``exp(mean CE)`` per document under the model (a corpus quality score)."""
    ce = cross_entropy_masked(doc_counts, model, group=(key,), k=k)
    return ce.withColumn("perplexity", F.exp("ce"))
