"""Candidate selection and evaluation over the sampled candidates and the test split."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.binary import utf8
from ..functions.rng import u01_sql
from ..operators import aligned as al
from ..operators import evaluate as ev
from ..operators import rewards as rw
from ..operators import select as sel
from ..operators import split
from .fixtures import SQL_COMPLETIONS, completions
from .models import SQL_BASE, model
from .registry import query
from .rewards import SQL_CANDS, scored, scored_lists, sql_totals
from .splits import SQL_PAIRS, pairs
from .training import SQL_LOGP, _sql_tokens

SEED = 42
KEYS = ["pair_id", "cand"]

SQL_SCORED = (
    SQL_CANDS + ", " + SQL_BASE[len("WITH ") :] + SQL_LOGP
    + f""", ms AS (SELECT pair_id, cand, avg(logp) AS model_score FROM lp GROUP BY pair_id, cand),
t1 AS ({sql_totals('1.0')} FROM sc),
ss AS (SELECT t1.pair_id, t1.cand, t1.gen_len, t1.ref_len, t1.base + t1.penalty AS total_reward, t1.base, t1.matches, t1.match_pos_sum,
         round(coalesce(ms.model_score, -ln(256.0)), 9) AS model_score FROM t1 LEFT JOIN ms USING (pair_id, cand))"""
)


def scored_with_model(spark, sf):
    """Candidates with totals at scale 1.0 and ``model_score`` = mean log-prob per byte."""
    s = scored_lists(spark, sf, al.dense_model(model(spark, sf)))
    mean = F.when(F.size("logps") > 0, al.total("logps") / F.size("logps")).otherwise(F.lit(-math.log(256.0)))
    s = s.withColumn("model_score", F.round(mean, 9)).drop("base", "scores", "logps")
    return rw.total_reward(s.withColumn("scale", F.lit(1.0)), "scale")


@query(
    "accept_reject",
    sql=SQL_SCORED
    + """, a AS (SELECT pair_id, (total_reward >= 0.5 OR gen_len >= ref_len) AS accepted FROM ss)
SELECT pair_id, count(*) AS n_cands, CAST(count_if(accepted) AS BIGINT) AS n_accepted, round(CAST(count_if(accepted) AS BIGINT) / count(*), 6) AS accept_rate FROM a GROUP BY pair_id""",
)
def q_accept_reject(spark, sf):
    t = rw.total_reward(scored(spark, sf).withColumn("scale", F.lit(1.0)), "scale")
    a = sel.accept_rate(sel.accept_reject(t, 0.5))
    return a.select("pair_id", "n_cands", "n_accepted", F.round("accept_rate", 6).alias("accept_rate"))


@query(
    "rerank_top_k",
    sql=SQL_SCORED
    + """, r AS (SELECT pair_id, cand, row_number() OVER (PARTITION BY pair_id ORDER BY round(model_score + total_reward, 9) DESC, cand ASC) AS rank FROM ss)
SELECT pair_id, cand, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""",
)
def q_rerank_top_k(spark, sf):
    s = scored_with_model(spark, sf).withColumn("score", F.round(F.col("model_score") + F.col("total_reward"), 9))
    return sel.rerank_top_k(s, 2).select("pair_id", "cand", "rank")


@query(
    "reward_weighted_probs",
    sql=SQL_SCORED
    + """, z AS (SELECT pair_id, cand, model_score + total_reward - max(model_score + total_reward) OVER (PARTITION BY pair_id) AS z FROM ss)
SELECT pair_id, cand, round(exp(z) / sum(exp(z)) OVER (PARTITION BY pair_id), 6) AS prob FROM z""",
)
def q_reward_weighted_probs(spark, sf):
    p = sel.reward_weighted_probs(scored_with_model(spark, sf))
    return p.select("pair_id", "cand", F.round("prob", 6).alias("prob"))


SWEEP = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)


@query(
    "scale_sweep",
    sql=SQL_SCORED
    + """, sx AS (SELECT ss.pair_id, ss.cand, ss.gen_len, ss.ref_len, ss.base, s.scale FROM ss,
      (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE), (2.5::DOUBLE), (3.0::DOUBLE), (3.5::DOUBLE)) s(scale)),
tt AS (SELECT *, base + CASE WHEN gen_len < ref_len THEN -0.5 * scale * (ref_len - gen_len)::DOUBLE / ref_len ELSE 0.0 END AS total FROM sx),
bb AS (SELECT pair_id, scale, arg_max(cand, (total, cand)) AS best FROM tt GROUP BY pair_id, scale),
pa AS (SELECT scale, CAST(count_if(total >= 0) AS BIGINT) AS n_accepted, avg(total) AS avg_total FROM tt GROUP BY scale),
pb AS (SELECT scale, CAST(count_if(best = 'model') AS BIGINT) AS n_best_model FROM bb GROUP BY scale)
SELECT scale, n_accepted, round(avg_total, 6) AS avg_total, n_best_model FROM pa JOIN pb USING (scale)""",
)
def q_scale_sweep(spark, sf):
    s = scored(spark, sf)
    w = sel.scale_sweep(s, SWEEP)
    return w.select("scale", "n_accepted", F.round("avg_total", 6).alias("avg_total"), "n_best_model")


# ---- tags and evaluation --------------------------------------------------------------------------

SQL_TAGS = f"""WITH c AS ({SQL_COMPLETIONS}),
tp AS (SELECT pair_id, completion AS generated, strpos(completion, '<think>') - 1 AS think_start, strpos(completion, '</think>') - 1 AS think_end,
         strpos(completion, '<answer>') - 1 AS answer_start, strpos(completion, '</answer>') - 1 AS answer_end FROM c),
tf AS (SELECT *, think_start >= 0 AND think_end > think_start AS has_thinking, answer_start >= 0 AND answer_end > answer_start AS has_answer FROM tp)"""


def tagged(spark, sf):
    c = completions(spark, sf).select("pair_id", F.col("completion").alias("generated"))
    return ev.tag_flags(ev.tag_positions(c, "generated"))


@query("tag_positions", sql=SQL_TAGS + " SELECT pair_id, CAST(think_start AS INTEGER) AS think_start, CAST(think_end AS INTEGER) AS think_end, CAST(answer_start AS INTEGER) AS answer_start, CAST(answer_end AS INTEGER) AS answer_end FROM tp")
def q_tag_positions(spark, sf):
    return tagged(spark, sf).select("pair_id", "think_start", "think_end", "answer_start", "answer_end")


@query("tag_flags", sql=SQL_TAGS + " SELECT pair_id, has_thinking, has_answer FROM tf")
def q_tag_flags(spark, sf):
    return tagged(spark, sf).select("pair_id", "has_thinking", "has_answer")


@query(
    "tag_spans",
    sql=SQL_TAGS
    + """ SELECT pair_id,
  CASE WHEN has_thinking THEN substring(generated, think_start + 1, least(think_end + 8, think_start + 300) - think_start) END AS think_span,
  CASE WHEN has_answer THEN substring(generated, answer_start + 1, least(answer_end + 9, answer_start + 300) - answer_start) END AS answer_span
FROM tf""",
)
def q_tag_spans(spark, sf):
    return ev.tag_spans(tagged(spark, sf), "generated", 300).select("pair_id", "think_span", "answer_span")


@query(
    "tag_spans_whole",
    sql=SQL_TAGS
    + """ SELECT pair_id,
  CASE WHEN has_thinking THEN substring(generated, think_start + 1, think_end + 8 - think_start) END AS think_span,
  CASE WHEN has_answer THEN substring(generated, answer_start + 1, answer_end + 9 - answer_start) END AS answer_span
FROM tf""",
)
def q_tag_spans_whole(spark, sf):
    """The sections through their closing tags, uncut."""
    return ev.tag_spans(tagged(spark, sf), "generated").select("pair_id", "think_span", "answer_span")


SQL_EVAL = f"""WITH pp AS ({SQL_PAIRS}),
r AS (SELECT pair_id, prompt, response, row_number() OVER (ORDER BY {u01_sql(SEED, "'split3'", 'pair_id')}, pair_id) - 1 AS pos, count(*) OVER () AS n FROM pp),
tst AS (SELECT pair_id, prompt, response AS reference FROM r WHERE pos >= n - ceil(0.2::DOUBLE * n) + (ceil(0.2::DOUBLE * n) - ceil(0.5::DOUBLE * ceil(0.2::DOUBLE * n)))),
c AS ({SQL_COMPLETIONS}),
res AS (SELECT t.pair_id, t.prompt, t.reference, c.completion AS generated, octet_length(encode(c.completion))::DOUBLE / 1000.0 AS generation_time,
          octet_length(encode(c.completion))::DOUBLE / greatest(octet_length(encode(t.reference)), 1) AS reward_score
        FROM tst t JOIN c USING (pair_id)),
ef AS (SELECT *, strpos(generated, '<think>') >= 1 AND strpos(generated, '</think>') > strpos(generated, '<think>') AS has_thinking,
         strpos(generated, '<answer>') >= 1 AND strpos(generated, '</answer>') > strpos(generated, '<answer>') AS has_answer FROM res)"""


def eval_results(spark, sf):
    """Test split prompts with their completions, a stand-in score (length ratio) for each and a stand-in
    generation time (1,000 bytes a second)."""
    p = pairs(spark, sf)
    test = split.split_three_way(p, "pair_id", 0.2, 0.5, SEED).where(F.col("split") == "test").select(
        "pair_id", "prompt", F.col("response").alias("reference")
    )
    size = F.octet_length("completion")
    done = completions(spark, sf)
    c = done.select("pair_id", F.col("completion").alias("generated"), (size / F.lit(1000.0)).alias("generation_time"))
    sc = done.select("pair_id", (size / F.greatest(F.octet_length("reference"), F.lit(1))).cast("double").alias("reward_score"))
    return ev.evaluation_table(test, c, sc)


@query("evaluation_table", sql=SQL_EVAL + " SELECT pair_id, prompt, reference, generated, has_thinking, has_answer, round(generation_time, 6) AS generation_time, round(reward_score, 6) AS reward_score FROM ef")
def q_evaluation_table(spark, sf):
    e = eval_results(spark, sf)
    return e.select("pair_id", "prompt", "reference", "generated", "has_thinking", "has_answer", F.round("generation_time", 6).alias("generation_time"), F.round("reward_score", 6).alias("reward_score"))


@query(
    "evaluation_summary",
    sql=SQL_EVAL
    + """ SELECT count(*) AS n_examples, round(avg(CAST(has_thinking AS INTEGER)), 6) AS thinking_rate, round(avg(CAST(has_answer AS INTEGER)), 6) AS answer_rate,
  round(avg(generation_time), 6) AS avg_generation_time, round(CASE WHEN count(*) = count(reward_score) THEN avg(reward_score) END, 6) AS avg_reward FROM ef""",
)
def q_evaluation_summary(spark, sf):
    s = ev.evaluation_summary(eval_results(spark, sf))
    return s.select("n_examples", *[F.round(c, 6).alias(c) for c in ("thinking_rate", "answer_rate", "avg_generation_time", "avg_reward")])
