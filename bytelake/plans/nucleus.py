"""Top-p filters and draws over the next-byte model and over part revenue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import u01_sql
from ..operators import aligned as al
from ..operators import alias
from ..operators import nucleus
from .models import SQL_BASE, model
from .registry import query, table

SEED = 42


def _sql_top_p(src: str, g: str, i: str, w: str, p: float) -> str:
    return f""", s AS (SELECT {g}, {i}, {w} AS w, sum({w}) OVER (PARTITION BY {g}) AS tot FROM {src}),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY {g} ORDER BY w DESC, {i} ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prec FROM s),
kp AS (SELECT {g}, {i}, w, w / tot AS share, w / sum(w) OVER (PARTITION BY {g}) AS prob FROM c WHERE prec <= {p}::DOUBLE * tot)"""


@query("top_p_filter", sql=SQL_BASE + ", mw AS (SELECT ctx, next, cnt + 1 AS w1 FROM m1)" + _sql_top_p("mw", "ctx", "next", "w1", 0.8) + " SELECT ctx, next, round(prob, 9) AS prob FROM kp")
def q_top_p_filter(spark, sf):
    """Nucleus (p = 0.8) of every context's add-one next-byte distribution (integer weights cnt + 1)."""
    m = model(spark, sf).withColumn("w1", F.col("cnt") + 1)
    k = nucleus.top_p_filter(m, "ctx", "next", "w1", 0.8)
    return k.select("ctx", "next", F.round("prob", 9).alias("prob"))


SQL_REVENUE = """WITH rev AS (SELECT p.p_brand, p.p_partkey, sum(l.l_extendedprice * (1 - l.l_discount)) AS revenue
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY p.p_brand, p.p_partkey)"""


def revenue(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    # aggregate lineitem first (partial aggregation), then attach the brand
    per_part = li.groupBy("l_partkey").agg(F.sum("rev").alias("revenue"))
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return per_part.join(part, per_part.l_partkey == part.p_partkey).select("p_brand", "p_partkey", "revenue")


@query(
    "top_p_business",
    sql=SQL_REVENUE + _sql_top_p("rev", "p_brand", "p_partkey", "revenue", 0.8)
    + " SELECT p_brand, p_partkey, round(share, 9) AS share, round(prob, 9) AS prob FROM kp",
)
def q_top_p_business(spark, sf):
    """Parts that cover 80 % of each brand's revenue."""
    k = nucleus.top_p_filter(revenue(spark, sf), "p_brand", "p_partkey", "revenue", 0.8)
    return k.select("p_brand", "p_partkey", F.round("share", 9).alias("share"), F.round("prob", 9).alias("prob"))


def _sql_draw(src: str, prob: str) -> str:
    return f""", cu AS (SELECT ctx, next, sum({prob}) OVER (PARTITION BY ctx ORDER BY next ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum({prob}) OVER (PARTITION BY ctx) AS tot FROM {src}),
dr AS (SELECT ctx, arg_min(next, cum) AS next FROM cu WHERE cum > {u01_sql(SEED, "'categorical'", 'ctx')} * tot GROUP BY ctx)"""


@query("sample_categorical", sql=SQL_BASE + _sql_draw("m1", "prob") + " SELECT ctx, next FROM dr")
def q_sample_categorical(spark, sf):
    return nucleus.sample_categorical(model(spark, sf), "ctx", "next", "prob", SEED)


@query(
    "sample_top_p",
    sql=SQL_BASE + ", mw AS (SELECT ctx, next, cnt + 1 AS w1 FROM m1)" + _sql_top_p("mw", "ctx", "next", "w1", 0.6) + _sql_draw("kp", "prob") + " SELECT ctx, next FROM dr",
)
def q_sample_top_p(spark, sf):
    m = model(spark, sf).withColumn("w1", F.col("cnt") + 1)
    return nucleus.sample_top_p(m, "ctx", "next", "w1", 0.6, SEED)


@query(
    "token_logprob",
    sql=SQL_BASE + _sql_draw("m1", "prob").replace("arg_min(next, cum) AS next", "arg_min(next, cum) AS next, arg_min(prob, cum) AS prob").replace("SELECT ctx, next, sum", "SELECT ctx, next, prob, sum")
    + " SELECT ctx, next, round(ln(prob), 9) AS logp FROM dr",
)
def q_token_logprob(spark, sf):
    m = model(spark, sf, shared=True)  # read by the draw and by the dense vector
    chosen = nucleus.sample_categorical(m, "ctx", "next", "prob", SEED)
    lp = al.token_logprob(chosen, al.dense_model(m))
    return lp.select("ctx", "next", F.round("logp", 9).alias("logp"))


@query("alias_tables", sql=SQL_BASE + " SELECT ctx, next, round(prob, 9) AS prob FROM m1")
def q_alias_tables(spark, sf):
    """The next-byte distribution as alias tables, read back from the tables' slots."""
    return alias.implied_masses(alias.build(model(spark, sf, shared=True), "ctx", "next", "prob"), "ctx", "next").select("ctx", "next", F.round("prob", 9).alias("prob"))


@query("sample_alias")
def q_sample_alias(spark, sf):
    """256 continuations drawn per context."""
    return alias.draw(alias.build(model(spark, sf, shared=True), "ctx", "next", "prob"), "ctx", "next", 256, SEED)
