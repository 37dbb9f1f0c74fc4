"""Embedding statistics (layer-normalised moments, EMA moments, threshold gate)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from .registry import query, table

EPS = "1e-5::DOUBLE"

SQL_LN = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
mv AS (SELECT vec_id, x, list_avg(x) AS m FROM e),
vv AS (SELECT vec_id, x, m, list_sum(list_transform(x, lambda v: (v - m) * (v - m))) / len(x) AS v FROM mv),
ln AS (SELECT vec_id, x, list_transform(x, lambda t: (t - m) / sqrt(v + {EPS})) AS xn FROM vv),
ex AS (SELECT vec_id, unnest(range(0, len(xn))) AS dim, unnest(xn) AS val FROM ln)"""


def emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


@query(
    "dim_moments",
    sql=SQL_LN + " SELECT CAST(dim AS INTEGER) AS dim, round(avg(val), 6) AS mean, round(var_pop(val), 6) AS var FROM ex GROUP BY dim",
)
def q_dim_moments(spark, sf):
    m = fe.dim_moments(emb(spark, sf))
    return m.select("dim", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


SQL_EMA = (
    SQL_LN
    + """, bi AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS b FROM e),
bs AS (SELECT bi.b, ex.dim, avg(ex.val) AS bm, var_pop(ex.val) AS bv FROM ex JOIN bi USING (vec_id) GROUP BY bi.b, ex.dim),
nb AS (SELECT max(b) + 1 AS nb FROM bi),
ema AS (SELECT dim, pow(0.99, nb) * 0.0 + sum(0.01 * pow(0.99, nb - 1 - b) * bm) AS running_mean,
               pow(0.99, nb) * 1.0 + sum(0.01 * pow(0.99, nb - 1 - b) * bv) AS running_var FROM bs, nb GROUP BY dim, nb)"""
)


@query("ema_moments", sql=SQL_EMA + " SELECT CAST(dim AS INTEGER) AS dim, round(running_mean, 6) AS running_mean, round(running_var, 6) AS running_var FROM ema")
def q_ema_moments(spark, sf):
    m = fe.ema_moments(emb(spark, sf), "vec_id", "embedding", 32)
    return m.select("dim", F.round("running_mean", 6).alias("running_mean"), F.round("running_var", 6).alias("running_var"))


@query(
    "threshold_gate",
    sql=SQL_EMA
    + """, th AS (SELECT dim, (1.0 / (1.0 + exp(-0.5))) * sqrt(greatest(running_var, 1e-6)) AS t FROM ema),
g AS (SELECT ex.vec_id, ex.dim, e.x[ex.dim + 1] AS xv, ex.val AS n, th.t FROM ex JOIN e USING (vec_id) JOIN th USING (dim)),
o AS (SELECT vec_id, greatest(-100.0, least(100.0, (1.0 / (1.0 + exp(-0.5))) * (1.0 / (1.0 + exp(-(abs(n) - t)))) * xv + (1.0 - 1.0 / (1.0 + exp(-0.5))) * xv)) AS y FROM g)
SELECT vec_id, round(sum(y), 6) AS gated_sum, round(sum(y * y), 6) AS gated_sq FROM o GROUP BY vec_id""",
)
def q_threshold_gate(spark, sf):
    e = emb(spark, sf)
    g = fe.threshold_gate(e, fe.ema_moments(e, "vec_id", "embedding", 32))
    s = F.aggregate("gated", F.lit(0.0), lambda a, v: a + v)
    q = F.aggregate("gated", F.lit(0.0), lambda a, v: a + v * v)
    return g.select("vec_id", F.round(s, 6).alias("gated_sum"), F.round(q, 6).alias("gated_sq"))
