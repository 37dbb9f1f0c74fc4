"""Per-byte lists of a sequence, aligned in its own row.

One Arrow pass over a candidate and its reference gives the reward list, the match scores and the model's log-probabilities as arrays;
losses, blends and errors zip those arrays inside the row.  Nothing is exploded to a row a byte and nothing is joined on a position, so what
moves between tasks does not grow with the length of the texts.

The k=1 next-byte model is one vector of 257 x 256 log-probabilities (row 256: no previous byte), gathered by index.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RewardConfig
from ..functions.arrow_counts import compare_bytes, value_bytes

CFG = RewardConfig()
VOCAB = 256
_SLICE = 512  # rows compared at once


def dense_model(model: DataFrame, unseen_logp: float = -math.log(VOCAB)) -> np.ndarray:
    """``ln(prob)`` of a k=1 model ``(ctx hex, next, prob)`` by ``ctx * 256 + next``; contexts without a row, and the first byte, have
    ``unseen_logp``.  At most 65,536 rows are read; a model of longer contexts is an error."""
    rows = model.select(
        F.octet_length("ctx").alias("width"), F.conv("ctx", 16, 10).cast("int").alias("ctx"), F.col("next").cast("int"), F.log("prob").alias("logp")
    )
    found = rows.limit(VOCAB * VOCAB + 1).toArrow()
    if found.num_rows > VOCAB * VOCAB or any(w != 2 for w in found.column("width").unique().to_pylist()):
        raise ValueError("a dense model has contexts of one byte")
    out = np.full((VOCAB + 1) * VOCAB, unseen_logp)
    out[found.column("ctx").to_numpy() * VOCAB + found.column("next").to_numpy()] = found.column("logp").to_numpy()
    return out


def logprob_values(data: np.ndarray, offsets: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The log-probability of each byte of consecutive values, given the byte before it in its value."""
    before = np.concatenate(([VOCAB], data[:-1].astype(np.int64))) if len(data) else np.zeros(0, np.int64)
    starts = offsets[:-1]
    before[starts[starts < offsets[1:]]] = VOCAB
    return vector[before * VOCAB + data]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64()))


def aligned_lists(df: DataFrame, gen: str, ref: str, vector: np.ndarray | None = None, alpha: float = 1.0, beta: float = -0.5, cfg: RewardConfig = CFG) -> DataFrame:
    """Adds ``gen_len``, ``ref_len``, ``base`` (rewards of the common positions before the end penalty), ``scores`` (``alpha`` per
    match, ``beta`` per mismatch), ``matches``, ``match_pos_sum``, and with a model ``logps`` (of every byte of ``gen``).  A null counts as empty."""
    held = df.sparkSession.sparkContext.broadcast(vector) if vector is not None else None
    x = df.withColumns({c: F.coalesce(F.octet_length(b), F.lit(0)) for c, b in (("gen_len", gen), ("ref_len", ref))})
    names = x.columns
    gi, ri = names.index(gen), names.index(ref)
    lists = ["base", "scores"] + (["logps"] if held else [])
    extra = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in lists] + [T.StructField(c, T.LongType()) for c in ("matches", "match_pos_sum")]
    base_reward = cfg.base_reward

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                row, pos, eq, n = compare_bytes(part.column(gi), part.column(ri))
                data, offsets = value_bytes(part.column(gi))
                sizes = np.diff(offsets)
                out = [
                    _lists(np.where(eq, base_reward * (0.1 + 0.9 * pos / np.maximum(sizes, 1)[row]), 0.0), n),
                    _lists(np.where(eq, alpha, beta), n),
                ]
                if held:
                    out.append(_lists(logprob_values(data, offsets, held.value), sizes))
                out.append(pa.array(np.bincount(row[eq], minlength=part.num_rows), pa.int64()))
                out.append(pa.array(np.bincount(row[eq], pos[eq], minlength=part.num_rows).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*names, *lists, "matches", "match_pos_sum"])

    return x.mapInArrow(run, T.StructType([*x.schema.fields, *extra]))


def total(values) -> Column:
    """Sum of an array (0.0 when empty)."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _mean(values, n) -> Column:
    return F.when(n > 0, total(values) / n)


def penalty(scale, cfg: RewardConfig = CFG) -> Column:
    g, r = F.col("gen_len"), F.col("ref_len")
    return F.when(g < r, F.lit(cfg.base_penalty) * scale * (r - g) / r).otherwise(F.lit(0.0))


def with_end_penalty(scale, cfg: RewardConfig = CFG) -> Column:
    """The whole reward list: the penalty on the last common position, or alone where there is none."""
    g, r = F.col("gen_len"), F.col("ref_len")
    pen, n = penalty(scale, cfg), F.size("base")
    ended = F.concat(F.slice("base", 1, n - 1), F.array(F.element_at("base", -1) + pen))
    return F.when(n > 0, ended).when(g < r, F.array(pen)).otherwise(F.col("base"))


def hybrid_list(rule: str, scores: str, w: float = CFG.reward_weight) -> Column:
    """``(1 - w) * rule + w * score`` per common position; the last score first gets half the sequence's mean score."""
    n = F.size(scores)
    last = F.element_at(scores, -1) + F.lit(0.5) * total(scores) / n
    scored = F.concat(F.slice(scores, 1, n - 1), F.array(last))
    return F.when(n > 0, F.zip_with(F.slice(rule, 1, n), scored, lambda a, b: F.lit(1 - w) * a + F.lit(w) * b)).otherwise(F.slice(rule, 1, 0))


def policy_loss_lists(df: DataFrame, rule: str, logps: str, reference_logp: float, accumulation: int = CFG.accumulation, kl_coef: float = CFG.kl_coef) -> DataFrame:
    """Adds ``n_tokens``, ``policy_loss`` (``-sum(logp * reward)`` on the common positions), ``kl_loss`` (``kl_coef`` times the summed difference to the
    reference's log-prob over all bytes), ``scaled_loss`` and ``avg_reward``; all 0 without common positions."""
    n = F.size("base")
    loss = -total(F.zip_with(F.slice(logps, 1, n), F.slice(rule, 1, n), lambda a, b: a * b))
    kl = F.lit(kl_coef) * (total(logps) - F.size(logps) * F.lit(reference_logp))
    zero = F.lit(0.0)
    x = df.withColumn("n_tokens", n.cast("long")).withColumn("policy_loss", F.when(n > 0, loss).otherwise(zero))
    x = x.withColumn("kl_loss", F.when(n > 0, kl).otherwise(zero)).withColumn("avg_reward", F.coalesce(_mean(F.slice(rule, 1, n), n), zero))
    return x.withColumn("scaled_loss", (F.col("policy_loss") + F.col("kl_loss")) / accumulation)


def fit_errors(df: DataFrame, rule: str, scores: str) -> DataFrame:
    """Per sequence with a reward list: ``token_mse`` of the scores (0 where there is none), ``seq_se`` of their mean against the list's total, and ``loss``."""
    n = F.size(rule)
    squares = F.zip_with(rule, scores, lambda a, b: F.pow(F.coalesce(b, F.lit(0.0)) - a, F.lit(2)))
    mean = F.coalesce(_mean(F.col(scores), F.size(scores)), F.lit(0.0))
    x = df.where(n > 0).withColumn("token_mse", total(squares) / n).withColumn("seq_se", F.pow(mean - total(rule), F.lit(2)))
    return x.withColumn("loss", F.col("token_mse") + F.col("seq_se"))


def episode_sums(df: DataFrame) -> DataFrame:
    """What a metric history needs of each sequence: log-prob weighted rewards, the last common log-prob, the reward total."""
    n = F.size("base")
    weighted = total(F.zip_with(F.slice("logps", 1, n), "base", lambda a, b: a * b))
    last = F.when(n > 0, F.get("logps", n - 1))
    return df.withColumns({"weighted": weighted, "last_logp": last, "base_total": total("base")}).drop("base", "scores", "logps")


def token_logprob(chosen: DataFrame, vector: np.ndarray, group: str = "ctx", item: str = "next", out: str = "logp") -> DataFrame:
    """Log-probability of each chosen token ``(ctx hex, next)``, gathered from the dense model."""
    held = chosen.sparkSession.sparkContext.broadcast(vector)
    x = chosen.withColumn("__at", F.conv(group, 16, 10).cast("long") * VOCAB + F.col(item))
    names = x.columns
    at = names.index("__at")

    def run(batches):
        for batch in batches:
            found = held.value[batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, out])

    return x.mapInArrow(run, T.StructType([*x.schema.fields, T.StructField(out, T.DoubleType())])).drop("__at")


def doc_perplexity(docs: DataFrame, key: str, text: str, vector: np.ndarray) -> DataFrame:
    """``(key, n_tokens, perplexity)`` of each document's bytes that follow another one (0 bytes don't count): ``exp(sum(nll) / (n + 1e-9))``.
    One pass, no shuffle; documents without such a byte are left out."""
    held = docs.sparkSession.sparkContext.broadcast(vector)
    x = docs.select(key, F.col(text).cast("binary").alias("__t"))
    schema = T.StructType([x.schema.fields[0], T.StructField("n_tokens", T.LongType()), T.StructField("perplexity", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                data, offsets = value_bytes(part.column(1))
                counted = data != 0
                starts = offsets[:-1]
                counted[starts[starts < offsets[1:]]] = False
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))[counted]
                n = np.bincount(row, minlength=part.num_rows)
                nll = np.bincount(row, -logprob_values(data, offsets, held.value)[counted], minlength=part.num_rows)
                found = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(np.exp(nll / (n + 1e-9)))], names=[key, "n_tokens", "perplexity"])
                yield found.filter(pa.array(n > 0))

    return x.mapInArrow(run, schema)
