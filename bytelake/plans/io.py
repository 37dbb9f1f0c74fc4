"""Source fallback, template pairs, history sink and dataset reuse."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import MOCK_RESPONSE, REWARD_SCALES
from ..sources import mock, parquet, sinks
from ..session import keep_until_drop
from .registry import ensure_scratch, materialize, query, table
from .rewards import SQL_REWARD_DATASET, q_reward_dataset
from .training import SQL_HISTORY_BASE, history

DATASET_VERSION = "v3"


@query("source_fallback", sql="SELECT doc_id, lang FROM documents")
def q_source_fallback(spark, sf):
    """The first readable of (a missing corpus, documents)."""
    base = sf.rstrip("/")
    df = parquet.source_fallback(spark, [f"{base}/missing_corpus.parquet", f"{base}/documents.parquet"])
    return df.select("doc_id", "lang")


@query(
    "mock_pairs",
    sql=f"""SELECT conv_id AS pair_id, 'Logic problem #' || CAST(conv_id AS VARCHAR) || ': Given the premises...' AS prompt,
  {"'" + MOCK_RESPONSE.replace(chr(10), "' || chr(10) || '") + "'"} AS response
FROM (SELECT DISTINCT conv_id FROM conversations)""",
)
def q_mock_pairs(spark, sf):
    """Template pairs, one per conversation id (the reference's mock set, sized by the data)."""
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    return mock.mock_pairs_for(ids, "conv_id")


@query(
    "write_history",
    sql=SQL_HISTORY_BASE
    + """ SELECT episode, round(penalty_scale, 6) AS penalty_scale, round(policy_loss, 6) AS policy_loss, round(avg_reward, 6) AS avg_reward,
  gen_len, ref_len, CAST(ceil(episode / 20) AS INTEGER) AS snapshot FROM hist""",
)
def q_write_history(spark, sf):
    """Append the episode history in two parts (snapshot partitions of 20 episodes; the cut lies inside a snapshot), repeat the second append,
    which changes nothing, and read the history back."""
    path = keep_until_drop(f"{ensure_scratch(spark)}/bytelake-history/{uuid.uuid4().hex}")
    h = history(spark, sf).select("episode", *[F.round(c, 6).alias(c) for c in ("penalty_scale", "policy_loss", "avg_reward")], "gen_len", "ref_len")
    h = materialize(h)
    first = F.col("episode") <= 30
    for part in (h.where(first), h.where(~first), h.where(~first)):
        sinks.append_history(part, path, every=20)
    return spark.read.parquet(path).select("episode", "penalty_scale", "policy_loss", "avg_reward", "gen_len", "ref_len", F.col("snapshot").cast("int"))


@query("reuse_or_build", sql=SQL_REWARD_DATASET)
def q_reuse_or_build(spark, sf):
    """The reward dataset, published once for these conversation files and parameters and reused from the shared folder afterwards."""
    mark = sinks.manifest(spark, [f"{sf.rstrip('/')}/conversations.parquet"], "reward_dataset", DATASET_VERSION, REWARD_SCALES)
    path = keep_until_drop(f"{ensure_scratch(spark)}/bytelake-datasets/{mark}")
    return sinks.reuse_or_build(spark, path, lambda: q_reward_dataset(spark, sf))
