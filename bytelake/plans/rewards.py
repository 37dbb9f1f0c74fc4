"""Rewards, variants, candidates and the reward dataset over conversation pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.binary import utf8
from ..functions.rng import u01_sql
from ..operators import aligned as al
from ..operators import rewards as rw
from ..operators import split
from .fixtures import SQL_COMPLETIONS, completions
from .registry import query
from .splits import SQL_PAIRS, pairs

SEED = 42

# ---- DuckDB twins -------------------------------------------------------------------------------
# Replacement decoding of a hex byte string, token by token (maximal-subpart rule): a complete
# UTF-8 sequence is kept, any incomplete prefix of one or any stray byte becomes EF BF BD.
_C = "[89AB][0-9A-F]"
RX_COMPLETE = (
    f"[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F]){_C}|E0[AB][0-9A-F]{_C}|E[1-9A-CEF]{_C}{_C}|ED[89][0-9A-F]{_C}"
    f"|F0(?:9[0-9A-F]|[AB][0-9A-F]){_C}{_C}|F[1-3]{_C}{_C}{_C}|F48[0-9A-F]{_C}{_C}"
)
RX_PARTIAL = (
    f"E0[AB][0-9A-F]|E[1-9A-CEF]{_C}|ED[89][0-9A-F]|F0(?:9[0-9A-F]|[AB][0-9A-F])(?:{_C})?|F[1-3]{_C}(?:{_C})?"
    f"|F48[0-9A-F](?:{_C})?|C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4]"
)
RX_TOKEN = f"(?:{RX_COMPLETE}|{RX_PARTIAL}|..)"


def sql_repair(hex_expr: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({hex_expr}, '{RX_TOKEN}'), "
        f"lambda t: CASE WHEN regexp_full_match(t, '(?:{RX_COMPLETE})') THEN t ELSE 'EFBFBD' END), '')"
    )


SQL_VARIANTS = f"""rb AS (SELECT pair_id, hex(encode(response)) AS h, octet_length(encode(response)) AS n FROM pp),
ed AS (SELECT pair_id, n, unnest(range(0, least(n // 10, 20))) AS j FROM rb),
ev AS (SELECT pair_id, j, CAST(floor({u01_sql(SEED, "'idx'", 'pair_id', 'j')} * n) AS BIGINT) AS pos,
              printf('%02X', CAST(floor({u01_sql(SEED, "'val'", 'pair_id', 'j')} * 256) AS INTEGER)) AS val FROM ed),
el AS (SELECT pair_id, pos, arg_max(val, j) AS val FROM ev GROUP BY pair_id, pos),
bx AS (SELECT pair_id, unnest(range(0, n)) AS pos, unnest(regexp_extract_all(h, '..')) AS b FROM rb),
cx AS (SELECT bx.pair_id, string_agg(coalesce(el.val, bx.b), '' ORDER BY bx.pos) AS ch FROM bx LEFT JOIN el USING (pair_id, pos) GROUP BY bx.pair_id),
raw AS (SELECT rb.pair_id, 'corrupt' AS cand, coalesce(cx.ch, '') AS rh FROM rb LEFT JOIN cx USING (pair_id)
        UNION ALL SELECT pair_id, 'p75', left(h, 2 * CAST(floor(n * 0.75::DOUBLE) AS BIGINT)) FROM rb
        UNION ALL SELECT pair_id, 'p50', left(h, 2 * CAST(floor(n * 0.5::DOUBLE) AS BIGINT)) FROM rb
        UNION ALL SELECT pair_id, 'p25', left(h, 2 * CAST(floor(n * 0.25::DOUBLE) AS BIGINT)) FROM rb),
var AS (SELECT pair_id, cand, {sql_repair('rh')} AS gh FROM raw)"""

SQL_CANDS = f"""WITH pp AS ({SQL_PAIRS}), cm AS ({SQL_COMPLETIONS}),
{SQL_VARIANTS},
cands AS (SELECT pair_id, 'model' AS cand, hex(encode(completion)) AS gh, includes_prompt FROM cm
          UNION ALL SELECT pair_id, cand, gh, false FROM var),
feat AS (SELECT c.pair_id, c.cand, c.includes_prompt, c.gh, hex(encode(p.response)) AS rh FROM cands c JOIN pp p USING (pair_id)),
fx AS (SELECT pair_id, cand, includes_prompt, gh, rh, length(gh) // 2 AS gen_len, length(rh) // 2 AS ref_len,
        list_zip(regexp_extract_all(gh, '..'), regexp_extract_all(rh, '..')) AS z FROM feat),
sc AS (SELECT pair_id, cand, includes_prompt, gh, rh, gen_len, ref_len, z,
        CAST(len(list_filter(z, lambda q: q[1] = q[2])) AS BIGINT) AS matches,
        CAST(coalesce(list_sum(list_transform(z, lambda q, i: CASE WHEN q[1] = q[2] THEN i - 1 ELSE 0 END)), 0) AS BIGINT) AS match_pos_sum
      FROM fx)"""


def sql_totals(scale: str) -> str:
    return f"""SELECT *, CASE WHEN gen_len < ref_len THEN -0.5 * {scale} * (ref_len - gen_len)::DOUBLE / ref_len ELSE 0.0 END AS penalty,
  1.0 * (0.1 * matches + 0.9 * match_pos_sum::DOUBLE / greatest(gen_len, 1)) AS base,
  least(gen_len, ref_len) + CASE WHEN least(gen_len, ref_len) = 0 AND gen_len < ref_len THEN 1 ELSE 0 END AS n_rewards"""


# ---- Spark plans ---------------------------------------------------------------------------------


def variants(spark, sf):
    return rw.synthetic_variants(pairs(spark, sf), "pair_id", "response", SEED, rw.REFERENCE_CHANGES)


def _candidates(spark, sf):
    cands = rw.candidates_in_row(completions(spark, sf), "pair_id", "reference", SEED, ("prompt",), rw.REFERENCE_CHANGES)
    return cands.withColumn("__g", utf8("completion")).withColumn("__r", utf8("reference"))


def scored(spark, sf):
    """Every pair's five candidates with their match features, in one pass over the pairs."""
    return rw.match_features(_candidates(spark, sf), "__g", "__r").drop("__g", "__r")


def scored_lists(spark, sf, vector=None):
    """Every pair's five candidates with their per-byte lists (and features), in one pass over the pairs."""
    return al.aligned_lists(_candidates(spark, sf), "__g", "__r", vector).drop("__g", "__r")


@query("synthetic_variants", sql=f"WITH pp AS ({SQL_PAIRS}), {SQL_VARIANTS} SELECT pair_id, cand, gh AS completion_hex FROM var")
def q_synthetic_variants(spark, sf):
    return variants(spark, sf).select("pair_id", "cand", F.hex(utf8("completion")).alias("completion_hex"))


@query(
    "synthetic_variants_whole",
    sql=f"WITH pp AS ({SQL_PAIRS}), {SQL_VARIANTS.replace('least(n // 10, 20)', 'n // 10')} SELECT pair_id, cand, gh AS completion_hex FROM var",
)
def q_synthetic_variants_whole(spark, sf):
    """The variants with a tenth of the bytes drawn anew in texts of any length."""
    v = rw.synthetic_variants(pairs(spark, sf), "pair_id", "response", SEED, None)
    return v.select("pair_id", "cand", F.hex(utf8("completion")).alias("completion_hex"))


@query("candidates", sql=SQL_CANDS + " SELECT pair_id, cand, includes_prompt, gen_len FROM sc")
def q_candidates(spark, sf):
    s = scored(spark, sf)
    return s.select("pair_id", "cand", "includes_prompt", F.col("gen_len").cast("long").alias("gen_len"))


@query(
    "token_rewards",
    sql=SQL_CANDS
    + """, tk AS (SELECT pair_id, cand, gen_len, unnest(range(0, least(gen_len, ref_len))) AS pos,
               unnest(list_transform(list_slice(z, 1, least(gen_len, ref_len)), lambda q: q[1] = q[2])) AS m
        FROM sc)
SELECT pair_id, cand, CAST(pos AS INTEGER) AS pos,
  round(CASE WHEN m THEN 1.0 * (0.1 + 0.9 * pos::DOUBLE / greatest(gen_len, 1)) ELSE 0.0 END, 9) AS reward FROM tk""",
)
def q_token_rewards(spark, sf):
    """Per-position rewards of every candidate before the end penalty (scale-free part)."""
    s = scored(spark, sf).withColumn("__g", utf8("completion")).withColumn("__r", utf8("reference"))
    t = rw.token_rewards(s, ["pair_id", "cand"], "__g", "__r", F.lit(0.0))
    return t.select("pair_id", "cand", "pos", F.round("reward", 9).alias("reward"))


@query(
    "end_only_penalty",
    sql=SQL_CANDS + f", t AS ({sql_totals('2.5')} FROM sc) SELECT pair_id, cand, round(penalty, 9) AS penalty FROM t",
)
def q_end_only_penalty(spark, sf):
    s = scored(spark, sf).withColumn("penalty", rw.end_only_penalty(F.lit(2.5)))
    return s.select("pair_id", "cand", F.round("penalty", 9).alias("penalty"))


@query(
    "total_reward",
    sql=SQL_CANDS
    + f""", t AS ({sql_totals('1.0')} FROM sc)
SELECT pair_id, cand, CAST(n_rewards AS INTEGER) AS n_rewards, round(base + penalty, 9) AS total_reward,
  round(CASE WHEN n_rewards > 0 THEN (base + penalty) / n_rewards ELSE 0.0 END, 9) AS mean_reward FROM t""",
)
def q_total_reward(spark, sf):
    t = rw.total_reward(scored(spark, sf).withColumn("scale", F.lit(1.0)), "scale")
    return t.select("pair_id", "cand", "n_rewards", F.round("total_reward", 9).alias("total_reward"), F.round("mean_reward", 9).alias("mean_reward"))


@query(
    "token_penalty_baseline",
    sql=SQL_CANDS + " SELECT pair_id, cand, round(CAST(1.0 * matches + (-0.5) * (least(gen_len, ref_len) - matches) AS DOUBLE), 6) AS baseline_reward FROM sc",
)
def q_token_penalty_baseline(spark, sf):
    b = rw.token_penalty_baseline(scored(spark, sf), 1.0, -0.5)
    return b.select("pair_id", "cand", F.round("baseline_reward", 6).alias("baseline_reward"))


@query(
    "penalty_scale",
    sql=f"""WITH p AS ({SQL_PAIRS}), e AS (SELECT pair_id, row_number() OVER (ORDER BY {u01_sql(SEED, "'shuffle'", 'pair_id')}, pair_id) - 1 AS episode,
  count(*) OVER () AS n FROM p)
SELECT pair_id, CAST(episode AS INTEGER) AS episode, round(1.0 + episode::DOUBLE / greatest(1, n - 1) * 1.5, 9) AS penalty_scale FROM e""",
)
def q_penalty_scale(spark, sf):
    """Curriculum over one pass of the pairs in shuffled order (episode e of E = number of pairs)."""
    p = split.shuffle_rows(pairs(spark, sf), "pair_id", SEED, "episode")
    n = p.agg(F.count(F.lit(1))).scalar()
    return p.select("pair_id", F.col("episode").cast("int").alias("episode"), F.round(rw.penalty_scale("episode", n, 2.5), 9).alias("penalty_scale"))


SQL_REWARD_LIST = """CASE WHEN least(gen_len, ref_len) = 0 THEN CASE WHEN gen_len < ref_len THEN [penalty] ELSE []::DOUBLE[] END
  ELSE list_transform(list_slice(z, 1, least(gen_len, ref_len)), lambda q, i:
    CASE WHEN q[1] = q[2] THEN 1.0::DOUBLE * (0.1::DOUBLE + 0.9::DOUBLE * (i - 1)::DOUBLE / greatest(gen_len, 1)::DOUBLE) ELSE 0.0::DOUBLE END
    + CASE WHEN i = least(gen_len, ref_len) THEN penalty ELSE 0.0::DOUBLE END) END"""

SQL_REWARD_DATASET = (
    SQL_CANDS
    + f""", sx AS (SELECT sc.*, s.scale FROM sc, (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE), (2.5::DOUBLE)) s(scale)),
t AS ({sql_totals('scale')} FROM sx),
tr AS (SELECT *, {SQL_REWARD_LIST} AS rewards FROM t)
SELECT t.pair_id, cand, scale, pp.prompt, pp.response AS reference, gh AS completion_hex, rh AS reference_hex, gen_len, ref_len, matches, match_pos_sum,
  CAST(n_rewards AS INTEGER) AS n_rewards, round(base + penalty, 9) AS total_reward,
  md5(array_to_string(list_transform(rewards, lambda v: CAST(CAST(round(v * 1000000.0::DOUBLE) AS BIGINT) AS VARCHAR)), ',')) AS rewards_md5
FROM tr t JOIN pp USING (pair_id)"""
)


@query("reward_dataset", sql=SQL_REWARD_DATASET)
def q_reward_dataset(spark, sf):
    """All pairs x 5 candidates x 4 penalty scales: texts, their bytes, the reward list (as a digest here) and totals."""
    s = al.aligned_lists(_candidates(spark, sf), "__g", "__r")
    n = F.size("base")

    def micros(v):
        return F.round(v * 1000000.0).cast("long").cast("string")

    # all that does not depend on the scale is made before the scales are exploded; only the last element differs
    s = s.withColumns({
        "head": F.array_join(F.transform(F.slice("base", 1, F.greatest(n - 1, F.lit(0))), micros), ","), "last": F.try_element_at("base", F.lit(-1)), "n": n,
        "completion_hex": F.hex("__g"), "reference_hex": F.hex("__r"),
    }).drop("base", "scores", "__g", "__r", "completion")
    d = rw.reward_dataset(s)
    lone = F.when(F.col("gen_len") < F.col("ref_len"), micros(F.col("penalty"))).otherwise(F.lit(""))
    ended = F.concat(F.col("head"), F.when(F.col("n") > 1, ",").otherwise(""), micros(F.col("last") + F.col("penalty")))
    digest = F.md5(F.when(F.col("n") > 0, ended).otherwise(lone))
    return d.select(
        "pair_id", "cand", "scale", "prompt", "reference", "completion_hex", "reference_hex",
        F.col("gen_len").cast("long").alias("gen_len"), F.col("ref_len").cast("long").alias("ref_len"),
        "matches", "match_pos_sum", "n_rewards", F.round("total_reward", 9).alias("total_reward"), digest.alias("rewards_md5"),
    )


@query(
    "scale_bucket",
    sql=f"""WITH p AS ({SQL_PAIRS}), e AS (SELECT row_number() OVER (ORDER BY {u01_sql(SEED, "'shuffle'", 'pair_id')}, pair_id) - 1 AS episode, count(*) OVER () AS n FROM p),
s AS (SELECT 1.0::DOUBLE + episode::DOUBLE / greatest(1, n - 1) * 1.5::DOUBLE AS s FROM e)
SELECT greatest(least(CAST(trunc((s - 1.0) * 10.0) AS INTEGER), 24), 0) AS bucket, count(*) AS n_rows FROM s GROUP BY 1""",
)
def q_scale_bucket(spark, sf):
    """Pairs per bucket of the penalty scale, over one pass of the pairs in shuffled order."""
    p = split.shuffle_rows(pairs(spark, sf), "pair_id", SEED, "episode")
    n = p.agg(F.count(F.lit(1))).scalar()
    b = p.select(rw.scale_bucket(rw.penalty_scale("episode", n, 2.5)).alias("bucket"))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))
