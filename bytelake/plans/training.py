"""Hybrid rewards, policy loss, reward-fit error and metric histories (re-aimed training steps)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.binary import utf8
from ..functions.rng import u01, u01_sql
from ..operators import aligned as al
from ..operators import metrics
from ..operators import rewards as rw
from ..operators import split
from .fixtures import completions
from .models import SQL_BASE, model
from .registry import query
from .rewards import SQL_CANDS, scored_lists
from .splits import SQL_PAIRS, pairs

SEED = 42
KEYS = ["pair_id", "cand"]


def _sql_tokens(scale: str) -> str:
    """CTEs: tk (match per common position), rule (rewards incl. end penalty), scd (alpha/beta scheme), seq."""
    return f""", tk AS (SELECT pair_id, cand, gen_len, ref_len, unnest(range(0, least(gen_len, ref_len))) AS pos,
               unnest(list_transform(list_slice(z, 1, least(gen_len, ref_len)), lambda q: q[1] = q[2])) AS m FROM sc),
pe AS (SELECT pair_id, cand, gen_len, ref_len, least(gen_len, ref_len) AS mlen,
       CASE WHEN gen_len < ref_len THEN -0.5 * {scale} * (ref_len - gen_len)::DOUBLE / ref_len ELSE 0.0 END AS pen FROM sc),
rule AS (SELECT tk.pair_id, tk.cand, tk.pos,
           CASE WHEN tk.m THEN 1.0 * (0.1 + 0.9 * tk.pos::DOUBLE / greatest(tk.gen_len, 1)) ELSE 0.0 END
           + CASE WHEN tk.pos = pe.mlen - 1 THEN pe.pen ELSE 0.0 END AS reward
         FROM tk JOIN pe USING (pair_id, cand)
         UNION ALL SELECT pair_id, cand, 0, pen FROM pe WHERE mlen = 0 AND gen_len < ref_len),
scd AS (SELECT pair_id, cand, pos, CASE WHEN m THEN 1.0 ELSE -0.5 END AS reward FROM tk),
seq AS (SELECT pair_id, cand, avg(reward) AS score, max(pos) AS lastp FROM scd GROUP BY pair_id, cand)"""


@query(
    "hybrid_reward",
    sql=SQL_CANDS + _sql_tokens("2.5")
    + """, s2 AS (SELECT scd.pair_id, scd.cand, scd.pos, scd.reward + CASE WHEN scd.pos = seq.lastp THEN 0.5 * coalesce(seq.score, 0.0) ELSE 0.0 END AS s
       FROM scd JOIN seq USING (pair_id, cand)),
hy AS (SELECT r.pair_id, r.cand, r.pos, 0.3 * r.reward + 0.7 * s2.s AS h FROM rule r JOIN s2 USING (pair_id, cand, pos))
SELECT pair_id, cand, count(*) AS n_tokens, round(sum(h), 6) AS hybrid_total FROM hy GROUP BY pair_id, cand""",
)
def q_hybrid_reward(spark, sf):
    """Rule rewards (scale 2.5) blended 0.3/0.7 with a stand-in scored list (+1 match / -0.5 mismatch,
    sequence score = its mean) on the common prefix of every candidate."""
    s = scored_lists(spark, sf).withColumn("rule", al.with_end_penalty(F.lit(2.5))).where(F.size("base") > 0)
    h = s.select(*KEYS, al.hybrid_list("rule", "scores", 0.7).alias("h"))
    return h.select(*KEYS, F.size("h").cast("long").alias("n_tokens"), F.round(al.total("h"), 6).alias("hybrid_total"))


SQL_LOGP = """, lt AS (SELECT pair_id, cand, unnest(range(0, gen_len)) AS pos,
        unnest(list_zip(list_slice(list_concat([NULL]::VARCHAR[], regexp_extract_all(gh, '..')), 1, gen_len), regexp_extract_all(gh, '..'))) AS t FROM sc),
lp AS (SELECT lt.pair_id, lt.cand, lt.pos, coalesce(ln(m1.prob), -ln(256.0)) AS logp
       FROM lt LEFT JOIN m1 ON m1.ctx = lt.t[1] AND m1.next = CAST(('0x' || lt.t[2]) AS INTEGER))"""


def _cands_with_model_sql() -> str:
    return SQL_CANDS + ", " + SQL_BASE[len("WITH ") :]


@query(
    "policy_loss",
    sql=_cands_with_model_sql() + _sql_tokens("1.0") + SQL_LOGP
    + """, j AS (SELECT lp.pair_id, lp.cand, lp.logp, rule.reward FROM lp JOIN rule USING (pair_id, cand, pos)),
a AS (SELECT pair_id, cand, count(*) AS n, -sum(logp * reward) AS loss, avg(reward) AS avg_reward FROM j GROUP BY pair_id, cand),
kl AS (SELECT pair_id, cand, 0.1::DOUBLE * sum(logp + ln(256.0)) AS kl_loss FROM lp GROUP BY pair_id, cand)
SELECT sc.pair_id, sc.cand, coalesce(a.n, 0) AS n_tokens, round(coalesce(a.loss, 0.0), 6) AS policy_loss,
  round(CASE WHEN a.n IS NOT NULL THEN kl.kl_loss ELSE 0.0 END, 6) AS kl_loss,
  round((coalesce(a.loss, 0.0) + CASE WHEN a.n IS NOT NULL THEN kl.kl_loss ELSE 0.0 END) / 4, 6) AS scaled_loss, round(coalesce(a.avg_reward, 0.0), 6) AS avg_reward
FROM sc LEFT JOIN a USING (pair_id, cand) LEFT JOIN kl USING (pair_id, cand)""",
)
def q_policy_loss(spark, sf):
    """REINFORCE loss of each candidate: log-probs under the counted model x rule rewards (scale 1), plus 0.1 times the
    summed per-byte KL estimate against the uniform reference (log-prob minus ln 1/256), divided by 4 steps."""
    s = scored_lists(spark, sf, al.dense_model(model(spark, sf))).withColumn("rule", al.with_end_penalty(F.lit(1.0)))
    loss = al.policy_loss_lists(s, "rule", "logps", -math.log(256.0), accumulation=4)
    return loss.select(*KEYS, "n_tokens", *[F.round(c, 6).alias(c) for c in ("policy_loss", "kl_loss", "scaled_loss", "avg_reward")])


@query(
    "reward_fit_error",
    sql=SQL_CANDS + _sql_tokens("1.0")
    + f""", tt AS (SELECT pair_id, cand, sum(reward) AS score FROM rule GROUP BY pair_id, cand),
tm AS (SELECT r.pair_id, r.cand, avg(pow(coalesce(s.reward, 0.0) - r.reward, 2)) AS token_mse FROM rule r LEFT JOIN scd s USING (pair_id, cand, pos) GROUP BY r.pair_id, r.cand),
se AS (SELECT tt.pair_id, tt.cand, pow(coalesce(seq.score, 0.0) - tt.score, 2) AS seq_se FROM tt LEFT JOIN seq USING (pair_id, cand)),
b AS (SELECT se.*, tm.token_mse, coalesce(tm.token_mse, 0.0) + se.seq_se AS loss,
        CAST(floor({u01_sql(SEED, "'fit'", 'se.pair_id')} * 10) AS BIGINT) AS batch FROM se LEFT JOIN tm USING (pair_id, cand))
SELECT batch, round(avg(token_mse), 6) AS token_mse, round(avg(seq_se), 6) AS seq_se, round(avg(loss), 6) AS loss, count(*) AS n
FROM b GROUP BY batch""",
)
def q_reward_fit_error(spark, sf):
    """Stand-in predictions (the alpha/beta scheme and its mean) against rule targets, 10 batches."""
    s = scored_lists(spark, sf).select(*KEYS, "scores", al.with_end_penalty(F.lit(1.0)).alias("rule"))
    batch = F.floor(u01(SEED, F.lit("fit"), F.col("pair_id")) * 10).cast("long").alias("batch")
    e = al.fit_errors(s, "rule", "scores").groupBy(batch)
    return e.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("token_mse", "seq_se", "loss")], F.count(F.lit(1)).alias("n"))


# ---- metric history: one episode per pair, in shuffled order -------------------------------------

SQL_PASS = f"""ep_n AS (SELECT pair_id, row_number() OVER (ORDER BY {u01_sql(SEED, "'shuffle'", 'pair_id')}, pair_id) - 1 AS e, count(*) OVER () AS n
  FROM ({SQL_PAIRS})),
ep AS (SELECT e AS episode, pair_id, 1.0::DOUBLE + e::DOUBLE / greatest(1, n - 1) * 1.5::DOUBLE AS penalty_scale FROM ep_n)"""


def history(spark, sf):
    p = split.shuffle_rows(pairs(spark, sf).select("pair_id"), "pair_id", SEED, "episode")
    n = p.agg(F.count(F.lit(1))).scalar()
    plan = p.select("pair_id", "episode", rw.penalty_scale("episode", n, 2.5).alias("penalty_scale"))
    c = completions(spark, sf).select("pair_id", utf8("completion").alias("__g"), utf8("reference").alias("__r"))
    s = al.aligned_lists(c, "__g", "__r", al.dense_model(model(spark, sf))).drop("__g", "__r")
    return metrics.metrics_history(plan, al.episode_sums(s))


SQL_HISTORY_BASE = (
    "WITH " + SQL_PASS + ", " + SQL_CANDS[len("WITH ") :] + ", " + SQL_BASE[len("WITH ") :]
    + _sql_tokens("0.0") + SQL_LOGP
    + """, ps AS (SELECT pe.pair_id, pe.gen_len, pe.ref_len, pe.mlen AS n,
          coalesce(sum(lp.logp * rule.reward), 0.0) AS a, arg_max(lp.logp, lp.pos) AS l, coalesce(sum(rule.reward), 0.0) AS bt
        FROM pe LEFT JOIN rule ON rule.pair_id = pe.pair_id AND rule.cand = pe.cand
             LEFT JOIN lp ON lp.pair_id = rule.pair_id AND lp.cand = rule.cand AND lp.pos = rule.pos
        WHERE pe.cand = 'model' GROUP BY pe.pair_id, pe.gen_len, pe.ref_len, pe.mlen),
hx AS (SELECT ep.episode + 1 AS episode, ep.penalty_scale, ps.gen_len, ps.ref_len, ps.n, ps.a, ps.l, ps.bt,
         CASE WHEN ps.gen_len < ps.ref_len THEN -0.5 * ep.penalty_scale * (ps.ref_len - ps.gen_len)::DOUBLE / ps.ref_len ELSE 0.0 END AS pen
       FROM ep JOIN ps USING (pair_id)),
hist AS (SELECT episode, penalty_scale, CASE WHEN n > 0 THEN -(a + l * pen) ELSE 0.0 END AS policy_loss,
           CASE WHEN n > 0 THEN (bt + pen) / n ELSE 0.0 END AS avg_reward, gen_len, ref_len FROM hx)"""
)


@query(
    "metrics_history",
    sql=SQL_HISTORY_BASE
    + " SELECT episode, round(penalty_scale, 6) AS penalty_scale, round(policy_loss, 6) AS policy_loss, round(avg_reward, 6) AS avg_reward, gen_len, ref_len FROM hist",
)
def q_metrics_history(spark, sf):
    """One row per episode (one per pair, in shuffled order): scale, REINFORCE loss and mean reward of the
    selected pair's model completion, generated and reference length."""
    h = history(spark, sf)
    return h.select("episode", *[F.round(c, 6).alias(c) for c in ("penalty_scale", "policy_loss", "avg_reward")], "gen_len", "ref_len")


@query(
    "metrics_log_points",
    sql=SQL_HISTORY_BASE
    + " SELECT episode, round(policy_loss, 6) AS policy_loss, round(avg_reward, 6) AS avg_reward, episode % 20 = 0 AS save_point FROM hist WHERE episode % 5 = 0",
)
def q_metrics_log_points(spark, sf):
    lp = metrics.metrics_log_points(history(spark, sf), 5, 20)
    return lp.select("episode", F.round("policy_loss", 6).alias("policy_loss"), F.round("avg_reward", 6).alias("avg_reward"), "save_point")


@query(
    "metrics_series",
    sql=SQL_HISTORY_BASE
    + """, u AS (SELECT episode, 'penalty_scale' AS metric, penalty_scale AS value FROM hist
   UNION ALL SELECT episode, 'policy_loss', policy_loss FROM hist UNION ALL SELECT episode, 'avg_reward', avg_reward FROM hist)
SELECT episode, metric, round(value, 6) AS value FROM u WHERE (SELECT count(*) FROM hist) >= 2""",
)
def q_metrics_series(spark, sf):
    s = metrics.metrics_series(history(spark, sf), ["penalty_scale", "policy_loss", "avg_reward"])
    return s.select("episode", "metric", F.round("value", 6).alias("value"))
