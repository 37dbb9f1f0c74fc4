"""Sampling and splitting over documents and conversation pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import u01_sql
from ..operators import formatting, split
from .registry import query, table

SEED = 42

SQL_PAIRS = """SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS pair_id, text AS prompt, next_text AS response
FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) nt
WHERE role = 'user' AND next_role = 'assistant'"""


def pairs(spark, sf):
    return formatting.pair_turns(table(spark, sf, "conversations"))


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")




def u_sql(purpose, key, seed=SEED):
    """DuckDB twin of the draw an operator makes for a row."""
    return u01_sql(seed, f"'{purpose}'", key)



@query(
    "split_three_way",
    sql=f"""WITH p AS ({SQL_PAIRS}),
r AS (SELECT pair_id, row_number() OVER (ORDER BY {u_sql("split3", "pair_id")}, pair_id) - 1 AS pos, count(*) OVER () AS n FROM p),
c AS (SELECT pair_id, pos, n, ceil(0.2::DOUBLE * n) AS n_hold FROM r)
SELECT pair_id, CASE WHEN pos < n - n_hold THEN 'train'
                     WHEN pos < n - n_hold + (n_hold - ceil(0.5::DOUBLE * n_hold)) THEN 'val' ELSE 'test' END AS split
FROM c""",
)
def q_split_three_way(spark, sf):
    return split.split_three_way(pairs(spark, sf), "pair_id", 0.2, 0.5, SEED).select("pair_id", "split")


@query(
    "split_two_way",
    sql=f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {u_sql("split2", "doc_id")}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN pos < n - ceil(0.1::DOUBLE * n) THEN 'train' ELSE 'val' END AS split FROM r""",
)
def q_split_two_way(spark, sf):
    return split.split_two_way(docs(spark, sf), "doc_id", 0.1, SEED).select("doc_id", "split")


@query(
    "split_hash",
    sql=f"""SELECT doc_id, CASE WHEN {u_sql("split_hash", "doc_id")} < 0.8::DOUBLE THEN 'train' WHEN {u_sql("split_hash", "doc_id")} < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split
FROM documents""",
)
def q_split_hash(spark, sf):
    return split.split_hash(docs(spark, sf), "doc_id", (0.8, 0.1, 0.1), seed=SEED).select("doc_id", "split")


@query(
    "split_fraction_independent",
    sql=f"""SELECT doc_id, 'a' AS sample FROM documents WHERE {u_sql("fraction", "doc_id")} < 0.9::DOUBLE
UNION ALL SELECT doc_id, 'b' AS sample FROM documents WHERE {u_sql("fraction", "doc_id")} < 0.1::DOUBLE""",
)
def q_split_fraction_independent(spark, sf):
    a, b = split.split_fraction_independent(docs(spark, sf), "doc_id", 0.9, 0.1, SEED)
    return a.select("doc_id", F.lit("a").alias("sample")).unionByName(b.select("doc_id", F.lit("b").alias("sample")))




@query(
    "split_leak_check",
    sql=f"""WITH a AS (SELECT doc_id, text FROM documents WHERE {u_sql("fraction", "doc_id")} < 0.9::DOUBLE),
b AS (SELECT doc_id, text FROM documents WHERE {u_sql("fraction", "doc_id", 7)} < 0.1::DOUBLE)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
  (SELECT count(*) FROM b WHERE doc_id IN (SELECT doc_id FROM a)) AS key_overlap,
  (SELECT count(*) FROM b WHERE text IN (SELECT text FROM a)) AS text_overlap,
  (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS key_only_b""",
)
def q_split_leak_check(spark, sf):
    """Leak between a 90 % sample and an independently seeded 10 % sample (exact copies count by text)."""
    a, b = split.split_fraction_independent(docs(spark, sf), "doc_id", 0.9, 0.1, SEED, 7)
    return split.split_leak_check(a, b, "doc_id", "text")


@query(
    "split_sizes",
    sql=f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {u_sql("split3", "doc_id")}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
c AS (SELECT pos, n, ceil(0.2::DOUBLE * n) AS n_hold FROM r),
s AS (SELECT CASE WHEN pos < n - n_hold THEN 'train'
                  WHEN pos < n - n_hold + (n_hold - ceil(0.5::DOUBLE * n_hold)) THEN 'val' ELSE 'test' END AS split FROM c)
SELECT split, count(*) AS n_rows FROM s GROUP BY split""",
)
def q_split_sizes(spark, sf):
    return split.split_sizes(split.split_three_way(docs(spark, sf), "doc_id", 0.2, 0.5, SEED))


@query(
    "sample_fixed_n",
    sql=f"WITH p AS ({SQL_PAIRS}) SELECT pair_id, prompt FROM p ORDER BY {u_sql("sample", "pair_id")}, pair_id LIMIT 50",
)
def q_sample_fixed_n(spark, sf):
    return split.sample_fixed_n(pairs(spark, sf), "pair_id", 50, SEED).select("pair_id", "prompt")


@query(
    "draw_with_replacement",
    sql=f"""WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
n AS (SELECT count(*) AS n FROM documents)
SELECT d.id AS draw, x.doc_id FROM range(2048) d(id), n JOIN x ON x.idx = floor({u_sql('draw', 'd.id')} * n.n)""",
)
def q_draw_with_replacement(spark, sf):
    """A batch of 2,048 documents drawn with replacement."""
    return split.draw_with_replacement(docs(spark, sf), "doc_id", 2048, SEED).select("draw", "doc_id")


@query(
    "shuffle_rows",
    sql=f"SELECT doc_id, row_number() OVER (ORDER BY {u_sql("shuffle", "doc_id")}, doc_id) - 1 AS pos FROM documents",
)
def q_shuffle_rows(spark, sf):
    return split.shuffle_rows(docs(spark, sf), "doc_id", SEED).select("doc_id", "pos")


# DuckDB: 100 episodes over 5 sampled pairs (CTE names prefixed ep_ so they can be chained)
SQL_EPISODES = f"""ep_p AS ({SQL_PAIRS}),
ep_c AS (SELECT pair_id, row_number() OVER (ORDER BY {u_sql('sample', 'pair_id')}, pair_id) - 1 AS slot FROM (SELECT * FROM ep_p ORDER BY {u_sql('sample', 'pair_id')}, pair_id LIMIT 5)),
ep_k AS (SELECT count(*) AS k FROM ep_c),
ep_e AS (SELECT range AS e FROM range(100)),
ep AS (SELECT CAST(e AS INTEGER) AS episode, ep_c.pair_id, 1.0::DOUBLE + e::DOUBLE / greatest(1, 99) * 1.5::DOUBLE AS penalty_scale,
  (e + 1) % 5 = 0 AS log_point, (e + 1) % 20 = 0 AS save_point
  FROM ep_e, ep_k JOIN ep_c ON ep_c.slot = floor({u01_sql(SEED, "'episode'", 'e')} * ep_k.k))"""


@query(
    "episode_plan",
    sql=f"WITH {SQL_EPISODES} SELECT episode, pair_id, round(penalty_scale, 6) AS penalty_scale, log_point, save_point FROM ep",
)
def q_episode_plan(spark, sf):
    plan = split.episode_plan(pairs(spark, sf), "pair_id", 100, 5, 5, 20, 2.5, SEED)
    return plan.select("episode", "pair_id", F.round("penalty_scale", 6).alias("penalty_scale"), "log_point", "save_point")
