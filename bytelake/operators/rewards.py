"""Position-scaled rewards with an end-only penalty, synthetic variants and the reward dataset.

Per (candidate, reference) the reward list is ``base * (0.1 + 0.9 * i / gen_len)`` at matching
byte positions ``i < min(gen_len, ref_len)`` and 0 elsewhere; when the candidate is shorter than
the reference, ``base_penalty * scale * (ref_len - gen_len) / ref_len`` is added to the last
element (or is the only element).  Hence ``total = base * (0.1 * M + 0.9 * S / gen_len) + penalty``
with M = number of matches and S = sum of their positions: the byte comparison runs once per
candidate (one pass inside the row) and scales are applied afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import REWARD_SCALES, RewardConfig
from ..functions.arrow_counts import compare_bytes, value_bytes
from ..functions.binary import col_, utf8, valid_utf8_text
from ..functions.rng import u01

CFG = RewardConfig()


def penalty_scale(episode, total_episodes, max_scale: float = CFG.max_penalty_scale) -> Column:
    """``1 + e / max(1, E - 1) * (max_scale - 1)``."""
    e = col_(episode)
    E = total_episodes if isinstance(total_episodes, Column) else F.lit(total_episodes)
    return F.lit(1.0) + e / F.greatest(F.lit(1), E - 1) * F.lit(max_scale - 1.0)


_SLICE = 512  # rows compared at once


def match_features(df: DataFrame, gen: str, ref: str) -> DataFrame:
    """Adds ``gen_len``, ``ref_len``, ``matches`` (M) and ``match_pos_sum`` (S): one comparison of the Arrow
    byte buffers per batch."""
    names = df.columns
    gi, ri = names.index(gen), names.index(ref)
    extra = [T.StructField("matches", T.LongType()), T.StructField("match_pos_sum", T.LongType())]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                row, pos, eq, _ = compare_bytes(part.column(gi), part.column(ri))
                m = np.bincount(row[eq], minlength=part.num_rows)
                s = np.bincount(row[eq], pos[eq], minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m, pa.int64()), pa.array(s, pa.int64())], names=[*names, "matches", "match_pos_sum"])

    lens = df.withColumn("gen_len", F.octet_length(gen)).withColumn("ref_len", F.octet_length(ref))
    names = lens.columns
    return lens.mapInArrow(run, T.StructType([*lens.schema.fields, *extra]))


def end_only_penalty(scale, cfg: RewardConfig = CFG) -> Column:
    """Penalty for an incomplete candidate (0 when ``gen_len >= ref_len``)."""
    g, r = F.col("gen_len"), F.col("ref_len")
    return F.when(g < r, F.lit(cfg.base_penalty) * col_(scale) * (r - g) / r).otherwise(F.lit(0.0))


def total_reward(df: DataFrame, scale: str = "scale", cfg: RewardConfig = CFG) -> DataFrame:
    """``n_rewards``, ``total_reward`` and ``mean_reward`` (0.0 for an empty list) from the features."""
    g, r = F.col("gen_len"), F.col("ref_len")
    base = F.lit(cfg.base_reward) * (F.lit(0.1) * F.col("matches") + F.lit(0.9) * F.col("match_pos_sum") / F.greatest(g, F.lit(1)))
    pen = end_only_penalty(scale, cfg)
    n = F.least(g, r) + F.when((F.least(g, r) == 0) & (g < r), 1).otherwise(0)
    return (
        df.withColumn("penalty", pen)
        .withColumn("n_rewards", n.cast("int"))
        .withColumn("total_reward", base + pen)
        .withColumn("mean_reward", F.when(n > 0, (base + pen) / n).otherwise(F.lit(0.0)))
    )


def with_reward_array(df: DataFrame, gen: str, ref: str, scale, out: str = "rewards", cfg: RewardConfig = CFG) -> DataFrame:
    """Adds the per-position reward list ``out`` (``array<double>``, penalty on the last element)."""
    x = df.withColumn("__scale", col_(scale).cast("double"))
    names = x.columns
    gi, ri, si = names.index(gen), names.index(ref), names.index("__scale")
    base, penalty = cfg.base_reward, cfg.base_penalty

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                row, pos, eq, n = compare_bytes(part.column(gi), part.column(ri))
                glen, rlen = (np.diff(value_bytes(part.column(k))[1]) for k in (gi, ri))
                value = np.where(eq, base * (0.1 + 0.9 * pos / np.maximum(glen, 1)[row]), 0.0)
                pen = np.where(glen < rlen, penalty * part.column(si).to_numpy(zero_copy_only=False) * (rlen - glen) / np.maximum(rlen, 1), 0.0)
                ends = np.cumsum(n)
                some = n > 0
                value[ends[some] - 1] += pen[some]
                lists = [value[e - k : e] if k else (pen[i : i + 1] if short else value[:0]) for i, (e, k, short) in enumerate(zip(ends, n, glen < rlen))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.float64()))], names=[*names, out])

    return x.mapInArrow(run, T.StructType([*x.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])).drop("__scale")


def _positions(df: DataFrame, keys: list[str], upto: Column, carry: list[str]) -> DataFrame:
    """One row per position ``0 <= pos < upto`` (explode of a sequence: whole-stage codegen, the
    byte columns in ``carry`` are read by position with binary ``substring``)."""
    return df.where(upto > 0).select(*keys, *carry, F.explode(F.sequence(F.lit(0), upto - 1)).alias("pos"))


def _byte_at(col: str, pos: Column) -> Column:
    return F.substring(F.col(col), pos + 1, 1)


def token_rewards(df: DataFrame, keys: list[str], gen: str, ref: str, scale, cfg: RewardConfig = CFG) -> DataFrame:
    """Long form ``(keys…, pos, reward)`` of the reward list (same values as :func:`with_reward_array`).

    Positions are generated rows compared byte by byte; the end penalty lands on the last common
    position, or forms the only row when there is no common position.
    """
    g, r = F.octet_length(gen), F.octet_length(ref)
    m = F.least(g, r)
    x = df.select(*keys, F.col(gen).alias("__g"), F.col(ref).alias("__r"), col_(scale).alias("__s"))
    pen = F.when(F.col("__gl") < F.col("__rl"), F.lit(cfg.base_penalty) * F.col("__s") * (F.col("__rl") - F.col("__gl")) / F.col("__rl")).otherwise(F.lit(0.0))
    x = x.withColumn("__gl", F.octet_length("__g")).withColumn("__rl", F.octet_length("__r")).withColumn("__m", F.least("__gl", "__rl"))
    x = x.withColumn("__pen", pen)
    pos = _positions(x, keys, F.col("__m"), ["__g", "__r", "__gl", "__m", "__pen"])
    p = F.col("pos")
    base = F.when(_byte_at("__g", p) == _byte_at("__r", p), F.lit(cfg.base_reward) * (F.lit(0.1) + F.lit(0.9) * p / F.greatest(F.col("__gl"), F.lit(1)))).otherwise(F.lit(0.0))
    rows = pos.select(*keys, p.cast("int").alias("pos"), (base + F.when(p == F.col("__m") - 1, F.col("__pen")).otherwise(F.lit(0.0))).alias("reward"))
    lone = x.where((F.col("__m") == 0) & (F.col("__gl") < F.col("__rl"))).select(*keys, F.lit(0).alias("pos"), F.col("__pen").alias("reward"))
    return rows.unionByName(lone)


def token_matches(df: DataFrame, keys: list[str], gen: str, ref: str) -> DataFrame:
    """Long form ``(keys…, pos, match)`` over the common prefix of two byte strings."""
    x = df.select(*keys, F.col(gen).alias("__g"), F.col(ref).alias("__r"))
    pos = _positions(x, keys, F.least(F.octet_length("__g"), F.octet_length("__r")), ["__g", "__r"])
    p = F.col("pos")
    return pos.select(*keys, p.cast("int").alias("pos"), (_byte_at("__g", p) == _byte_at("__r", p)).alias("match"))


def token_logprobs(df: DataFrame, keys: list[str], gen: str, model: DataFrame, unseen_logp: float | None = None) -> DataFrame:
    """``(keys…, pos, logp)`` of each byte of ``gen`` given the previous byte under a k=1 model
    (``ctx`` hex, ``next``, ``prob``); position 0 and unseen contexts use the uniform ``ln(1/256)``.

    Positions are generated rows; one broadcast join with the model (at most 65,536 rows).
    """
    import math

    uni = unseen_logp if unseen_logp is not None else -math.log(256.0)
    x = df.select(*keys, F.col(gen).alias("__g"))
    pos = _positions(x, keys, F.octet_length("__g"), ["__g"])
    p = F.col("pos")
    t = pos.select(
        *keys,
        p.cast("int").alias("pos"),
        F.when(p > 0, F.hex(_byte_at("__g", p - 1))).alias("ctx"),
        F.conv(F.hex(_byte_at("__g", p)), 16, 10).cast("int").alias("next"),
    )
    m = F.broadcast(model.select("ctx", "next", F.log("prob").alias("__lp")))
    return t.join(m, ["ctx", "next"], "left").select(*keys, "pos", F.coalesce(F.col("__lp"), F.lit(uni)).alias("logp"))


def token_penalty_baseline(df: DataFrame, alpha: float = 1.0, beta: float = -0.5) -> DataFrame:
    """Comparison scheme: ``alpha`` per matching position, ``beta`` per mismatch, over the common prefix."""
    m = F.least("gen_len", "ref_len")
    return df.withColumn(
        "baseline_reward", F.lit(alpha) * F.col("matches") + F.lit(beta) * (m - F.col("matches"))
    )


def corrupted_bytes(ref: str, key: str, seed: int = 42, max_changes: int | None = None) -> Column:
    """``len // 10`` random byte replacements (position and value drawn per change), with ``max_changes`` at most so many;
    changes are applied in order, so a later change to the same position wins."""
    b = col_(ref)
    n = F.octet_length(b)
    k = F.floor(n / 10) if max_changes is None else F.least(F.floor(n / 10), F.lit(max_changes))
    k = k.cast("int")
    edits = F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda j: F.struct(
            F.floor(u01(seed, F.lit("idx"), F.col(key), j) * n).cast("int").alias("idx"),
            j.alias("j"),
            F.lpad(F.hex(F.floor(u01(seed, F.lit("val"), F.col(key), j) * 256).cast("int")), 2, "0").alias("val"),
        ),
    )
    # the last change of each position, in position order; each array is bound once, so the work grows with the text's length
    last = bound(F.array_sort(edits), lambda e: F.filter(e, lambda x, i: (i == F.size(e) - 1) | (F.get(e, i + 1)["idx"] != x["idx"])))

    def joined(e):
        kept = F.transform(e, lambda x, i: F.concat(_hex_between(b, F.when(i > 0, F.get(e, i - 1)["idx"] + 1).otherwise(0), x["idx"]), x["val"]))
        return F.unhex(F.concat(F.array_join(kept, ""), _hex_between(b, F.get(e, F.size(e) - 1)["idx"] + 1, n)))

    return F.when(k > 0, bound(last, joined)).otherwise(b)


def bound(array: Column, use) -> Column:
    """``use(array)`` with the array computed once."""
    return F.get(F.transform(F.array(array), use), F.lit(0))


def _hex_between(b: Column, start: Column, stop: Column) -> Column:
    return F.hex(F.substring(b, start + 1, stop - start))


REFERENCE_CHANGES = 20  # the cap of the reference's corrupted copy
VARIANT_FRACTIONS = (("p75", 0.75), ("p50", 0.5), ("p25", 0.25))


def synthetic_variants(
    pairs: DataFrame, key: str = "pair_id", ref: str = "response", seed: int = 42, max_changes: int | None = REFERENCE_CHANGES
) -> DataFrame:
    """Four variants per reference: corrupted copy and 75 / 50 / 25 % byte prefixes, each decoded with
    replacement (malformed sequences -> U+FFFD) as the candidate text ``completion``."""
    rb = utf8(ref)
    kinds = [F.struct(F.lit("corrupt").alias("cand"), corrupted_bytes("__rb", key, seed, max_changes).alias("raw"))]
    for name, f in VARIANT_FRACTIONS:
        kinds.append(F.struct(F.lit(name).alias("cand"), F.expr(f"substring(__rb, 1, CAST(floor(octet_length(__rb) * {f}D) AS INT))").alias("raw")))
    x = pairs.withColumn("__rb", rb).select(key, F.explode(F.array(*kinds)).alias("v"))
    return x.select(key, F.col("v.cand").alias("cand"), valid_utf8_text(F.col("v.raw")).alias("completion"))


def candidates(completions: DataFrame, variants: DataFrame, key: str = "pair_id") -> DataFrame:
    """Model completion (``cand = 'model'``) plus the synthetic variants, one row per candidate."""
    model = completions.select(key, F.lit("model").alias("cand"), "completion", "includes_prompt")
    return model.unionByName(variants.withColumn("includes_prompt", F.lit(False)))


def candidates_in_row(completions: DataFrame, key: str = "pair_id", ref: str = "reference", seed: int = 42, carry: tuple = (), max_changes: int | None = None) -> DataFrame:
    """The model completion and the synthetic variants of its reference, exploded inside the row (no join):
    ``(key, reference, cand, completion, includes_prompt)`` and the columns of ``carry``."""
    x = completions.withColumn("__rb", utf8(ref))
    kinds = [F.struct(F.lit("model").alias("cand"), F.col("completion"), F.col("includes_prompt"))]
    raw = [("corrupt", corrupted_bytes("__rb", key, seed, max_changes))]
    raw += [(name, F.expr(f"substring(__rb, 1, CAST(floor(octet_length(__rb) * {f}D) AS INT))")) for name, f in VARIANT_FRACTIONS]
    kinds += [F.struct(F.lit(n).alias("cand"), valid_utf8_text(b).alias("completion"), F.lit(False).alias("includes_prompt")) for n, b in raw]
    return x.select(key, ref, *carry, F.explode(F.array(*kinds)).alias("v")).select(key, ref, *carry, "v.*")


def scored_candidates(cands: DataFrame, refs: DataFrame, key: str = "pair_id", ref: str = "reference") -> DataFrame:
    """Attach the reference and the match features (text -> UTF-8 bytes on both sides)."""
    x = cands.join(refs.select(key, ref), key)
    x = x.withColumn("__g", utf8("completion")).withColumn("__r", utf8(ref))
    return match_features(x, "__g", "__r").drop("__g", "__r")


def with_scales(df: DataFrame, scales=REWARD_SCALES) -> DataFrame:
    """One row per penalty scale (an in-row explode of a literal array: no join)."""
    return df.withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))


def reward_dataset(scored: DataFrame, scales=REWARD_SCALES, cfg: RewardConfig = CFG) -> DataFrame:
    """Candidates × scales with features and totals; the comparison ran once per candidate."""
    return total_reward(with_scales(scored, scales), "scale", cfg)


def scale_bucket(scale) -> Column:
    """``int((s - 1.0) * 10)`` clamped to 0..24 (double arithmetic: 2.3 -> 12)."""
    return F.greatest(F.least(((col_(scale) - F.lit(1.0)) * F.lit(10.0)).cast("int"), F.lit(24)), F.lit(0))


def hybrid_reward(rule: DataFrame, scored: DataFrame, seq: DataFrame, keys: list[str], w: float = CFG.reward_weight) -> DataFrame:
    """``(1 - w) * rule + w * scored`` per position on the common prefix; the scored list's last
    element first gets ``+ 0.5 * sequence score``.  (Lists of different length are aligned by
    position instead of failing.)"""
    last = scored.groupBy(*keys).agg(F.max("pos").alias("__last"))
    s = scored.join(last, keys).join(seq, keys, "left").withColumn(
        "reward",
        F.when(F.col("pos") == F.col("__last"), F.col("reward") + F.lit(0.5) * F.coalesce(F.col("score"), F.lit(0.0))).otherwise(F.col("reward")),
    ).select(*keys, "pos", F.col("reward").alias("__s"))
    j = rule.join(s, keys + ["pos"])
    return j.select(*keys, "pos", (F.lit(1 - w) * F.col("reward") + F.lit(w) * F.col("__s")).alias("reward"))


def policy_loss(logprobs: DataFrame, rewards: DataFrame, keys: list[str], kl: DataFrame | None = None, accumulation: int = CFG.accumulation, kl_coef: float = CFG.kl_coef) -> DataFrame:
    """REINFORCE loss per key on the common prefix: ``-sum(logp * reward)`` (0.0 when empty)
    plus ``kl_coef * sum(kl)``; their total divided by the accumulation steps; the mean reward."""
    j = logprobs.join(rewards, keys + ["pos"])
    out = j.groupBy(*keys).agg(
        (-F.sum(F.col("logp") * F.col("reward"))).alias("policy_loss"),
        F.avg("reward").alias("avg_reward"),
        F.count(F.lit(1)).alias("n_tokens"),
    )
    if kl is not None:
        ks = kl.groupBy(*keys).agg(F.sum("kl").alias("__kl"))
        out = out.join(ks, keys, "left").withColumn("kl_loss", F.lit(kl_coef) * F.coalesce("__kl", F.lit(0.0))).drop("__kl")
    else:
        out = out.withColumn("kl_loss", F.lit(0.0))
    out = out.withColumn("total_loss", F.col("policy_loss") + F.col("kl_loss"))
    return out.withColumn("scaled_loss", F.col("total_loss") / accumulation)


def reward_fit_error(pred: DataFrame, target: DataFrame, pred_seq: DataFrame, target_seq: DataFrame, keys: list[str], batch_col: str) -> DataFrame:
    """Token MSE on the target's positions plus squared sequence error, per batch (``batch_col``)."""
    tok = target.join(pred.withColumnRenamed("reward", "__p"), keys + ["pos"], "left").withColumn(
        "__d2", F.pow(F.coalesce(F.col("__p"), F.lit(0.0)) - F.col("reward"), 2)
    )
    per_key = tok.groupBy(*keys).agg(F.avg("__d2").alias("token_mse"))
    seq = target_seq.withColumnRenamed("score", "__t").join(pred_seq.withColumnRenamed("score", "__p"), keys, "left")
    seq = seq.withColumn("seq_se", F.pow(F.coalesce(F.col("__p"), F.lit(0.0)) - F.col("__t"), 2))
    both = seq.join(per_key, keys, "left").withColumn("loss", F.coalesce(F.col("token_mse"), F.lit(0.0)) + F.col("seq_se"))
    return both.groupBy(batch_col).agg(
        F.avg("token_mse").alias("token_mse"), F.avg("seq_se").alias("seq_se"), F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n")
    )
