"""Derived fixture frames shared by several plans (all computed from the driver tables).

The fixtures hold no model output, so a deterministic stand-in completion is derived per pair:
about a third are the reference wrapped in think/answer tags after the prompt as reasoning,
a third repeat the reference exactly, a third answer with the prompt text (a wrong answer).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ANSWER_END_TAG, ANSWER_TAG, THINK_END_TAG, THINK_TAG
from ..functions.rng import u01, u01_sql
from .splits import SQL_PAIRS, pairs

SEED = 42


def completions(spark, sf, p=None):
    """``(pair_id, prompt, reference, completion, includes_prompt)`` (from ``p`` when given; also of a stream)."""
    p = pairs(spark, sf) if p is None else p
    u = u01(SEED, F.lit("gen"), F.col("pair_id"))
    tagged = F.concat(
        F.lit(THINK_TAG), F.col("prompt"), F.lit(THINK_END_TAG + "\n" + ANSWER_TAG), F.col("response"), F.lit(ANSWER_END_TAG)
    )
    comp = F.when(u < 1.0 / 3, tagged).when(u < 2.0 / 3, F.col("response")).otherwise(F.col("prompt"))
    return p.select(
        "pair_id", "prompt", F.col("response").alias("reference"), comp.alias("completion"), F.lit(False).alias("includes_prompt")
    )


_U_GEN = u01_sql(SEED, "'gen'", "pair_id")
SQL_COMPLETIONS = f"""SELECT pair_id, prompt, response AS reference,
  CASE WHEN {_U_GEN} < 1.0::DOUBLE / 3 THEN '{THINK_TAG}' || prompt || '{THINK_END_TAG}' || chr(10) || '{ANSWER_TAG}' || response || '{ANSWER_END_TAG}'
       WHEN {_U_GEN} < 2.0::DOUBLE / 3 THEN response ELSE prompt END AS completion,
  false AS includes_prompt
FROM ({SQL_PAIRS})"""
