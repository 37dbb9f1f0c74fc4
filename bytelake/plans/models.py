"""Next-byte model tables and losses over ``documents`` (threshold split train/val/test)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import u01, u01_sql
from ..operators import aligned as al
from ..operators import loss, ngram, split, stats
from .registry import materialize, query, table

SEED = 42
N_BATCHES = 20
U_DOC = u01_sql(SEED, "'split_hash'", "doc_id")
U_BATCH = u01_sql(SEED, "'batch'", "doc_id")


def split_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    d = split.split_hash(d, "doc_id", (0.8, 0.1, 0.1), seed=SEED)
    return d.withColumn("batch_id", F.floor(u01(SEED, F.lit("batch"), F.col("doc_id")) * N_BATCHES).cast("long"))


def train_counts(spark, sf):
    return ngram.ngram_counts(split_docs(spark, sf).where(F.col("split") == "train"), "text", 1)


def model(spark, sf, lam=1.0, shared=False):
    """The dense k=1 model (at most 65,536 rows).  ``shared=True`` writes it once to the shared
    folder for plans that read it from several branches; single-use plans keep it inline."""
    m = ngram.ngram_probs(train_counts(spark, sf), lam, dense=True)
    return materialize(m) if shared else m


# DuckDB: split documents, all bigrams (ctx hex, next) per document
SQL_BASE = f"""WITH sd AS (SELECT doc_id, text,
    CASE WHEN {U_DOC} < 0.8::DOUBLE THEN 'train' WHEN {U_DOC} < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split,
    CAST(floor({U_BATCH} * {N_BATCHES}) AS BIGINT) AS batch_id FROM documents),
tr AS (SELECT doc_id, split, batch_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM sd),
zz AS (SELECT doc_id, split, batch_id, unnest(list_zip(l[1:len(l)-1], l[2:len(l)])) AS z FROM tr),
bg AS (SELECT doc_id, split, batch_id, z[1] AS ctx, CAST(('0x' || z[2]) AS INTEGER) AS next FROM zz),
cnt AS MATERIALIZED (SELECT ctx, next, count(*) AS cnt FROM bg WHERE split = 'train' GROUP BY ctx, next),
tot AS (SELECT ctx, sum(cnt) AS ctx_total FROM cnt GROUP BY ctx),
grid AS MATERIALIZED (SELECT tot.ctx, CAST(r.range AS INTEGER) AS next, tot.ctx_total, coalesce(cnt.cnt, 0) AS cnt
         FROM tot CROSS JOIN range(256) r LEFT JOIN cnt ON cnt.ctx = tot.ctx AND cnt.next = CAST(r.range AS INTEGER)),
m1 AS MATERIALIZED (SELECT ctx, next, cnt, (cnt + 1.0::DOUBLE) / (ctx_total + 256.0::DOUBLE) AS prob FROM grid),
m0 AS (SELECT ctx, next, cnt, cnt::DOUBLE / ctx_total::DOUBLE AS prob FROM grid)"""


def _sql_scored(model_name: str, unseen: str, where: str = "TRUE", group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f""", d AS (SELECT {g}ctx, next, count(*) AS cnt FROM bg WHERE {where} AND next <> 0 GROUP BY ALL),
s AS (SELECT d.*, CASE WHEN NOT EXISTS (SELECT 1 FROM {model_name} mm WHERE mm.ctx = d.ctx) THEN {unseen}
                      ELSE coalesce(m.prob, 0.0) END AS p
      FROM d LEFT JOIN {model_name} m ON m.ctx = d.ctx AND m.next = d.next),
sc AS (SELECT *, CASE WHEN p > 0 THEN -ln(p) ELSE 'inf'::DOUBLE END AS nll FROM s)"""


@query("ngram_counts", sql=SQL_BASE + " SELECT ctx, next, cnt FROM cnt")
def q_ngram_counts(spark, sf):
    return train_counts(spark, sf)


@query("ngram_probs", sql=SQL_BASE + " SELECT ctx, next, cnt, round(prob, 9) AS prob FROM m1")
def q_ngram_probs(spark, sf):
    return model(spark, sf).select("ctx", "next", "cnt", F.round("prob", 9).alias("prob"))


@query(
    "softmax_rows",
    sql=SQL_BASE
    + """, lg AS (SELECT ctx, next, ln(cnt + 1.0::DOUBLE) AS logit FROM grid),
z AS (SELECT ctx, next, logit - max(logit) OVER (PARTITION BY ctx) AS z FROM lg),
ls AS (SELECT ctx, next, z - ln(sum(exp(z)) OVER (PARTITION BY ctx)) AS logp FROM z)
SELECT ctx, next, round(logp, 9) AS logp, round(exp(logp), 9) AS prob FROM ls""",
)
def q_softmax_rows(spark, sf):
    """Softmax of ``ln(cnt + 1)`` per context: equals the add-one model."""
    m = model(spark, sf).select("ctx", "next", F.log(F.col("cnt") + F.lit(1.0)).alias("logit"))
    s = ngram.softmax_rows(m, "ctx", "logit")
    return s.select("ctx", "next", F.round("logp", 9).alias("logp"), F.round("prob", 9).alias("prob"))


@query(
    "cross_entropy_masked",
    sql=SQL_BASE + _sql_scored("m1", "1.0::DOUBLE / 256", "split = 'val'")
    + " SELECT CAST(sum(cnt) AS BIGINT) AS n_tokens, round(sum(cnt * nll) / (sum(cnt) + 1e-9), 6) AS ce FROM sc",
)
def q_cross_entropy_masked(spark, sf):
    val = split_docs(spark, sf).where(F.col("split") == "val")
    ce = loss.cross_entropy_masked(ngram.ngram_counts(val, "text", 1), model(spark, sf))
    return ce.select("n_tokens", F.round("ce", 6).alias("ce"))


SQL_WEIGHTS = """, hb AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS hx FROM sd WHERE split = 'train'),
hc AS (SELECT CAST(('0x' || hx) AS INTEGER) AS byte, count(*) AS cnt FROM hb GROUP BY 1),
hist AS (SELECT CAST(r.range AS INTEGER) AS byte, coalesce(hc.cnt, 0) AS cnt FROM range(256) r LEFT JOIN hc ON hc.byte = r.range),
fq AS (SELECT byte, greatest(CASE WHEN sum(cnt) OVER () > 0 THEN cnt::DOUBLE / (sum(cnt) OVER ())::DOUBLE ELSE 1.0::DOUBLE / 256 END, 1e-5::DOUBLE) AS freq FROM hist),
wr AS (SELECT byte, least(pow(1.0::DOUBLE / freq, 0.5::DOUBLE), 10.0::DOUBLE) AS w FROM fq),
wt AS (SELECT byte, w * 256 / sum(w) OVER () AS weight FROM wr)"""


@query(
    "weighted_cross_entropy",
    sql=SQL_BASE + SQL_WEIGHTS + _sql_scored("m1", "1.0::DOUBLE / 256", "split = 'val'")
    + """, a AS (SELECT sum(cnt) AS n, sum(cnt * nll) / (sum(cnt) + 1e-9) AS ce,
         sum(cnt * nll * weight) / (sum(cnt) + 1e-9) AS wce FROM sc JOIN wt ON wt.byte = sc.next)
SELECT CAST(n AS BIGINT) AS n_tokens, round(ce, 6) AS ce, round(wce, 6) AS wce, round(abs(wce - ce), 6) AS proxy,
  round(wce + 0.1 * abs(wce - ce), 6) AS total FROM a""",
)
def q_weighted_cross_entropy(spark, sf):
    sd = split_docs(spark, sf)
    tr = sd.where(F.col("split") == "train")
    w = stats.token_weights(stats.token_frequencies(stats.byte_histogram(tr, "text")))
    val = sd.where(F.col("split") == "val")
    out = loss.weighted_cross_entropy(ngram.ngram_counts(val, "text", 1), model(spark, sf), w)
    return out.select("n_tokens", *[F.round(c, 6).alias(c) for c in ("ce", "wce", "proxy", "total")])


def batch_losses(spark, sf, lam):
    """Per (split, batch): CE of the batch's documents under the train model."""
    sd = split_docs(spark, sf)
    # group key: split index * N_BATCHES + batch
    sidx = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    sd = sd.withColumn("grp_id", (sidx * N_BATCHES + F.col("batch_id")).cast("long"))
    counts = ngram.ngram_counts(sd, "text", 1, group_col="grp_id")
    unseen = 1.0 / 256 if lam > 0 else 0.0
    ce = loss.cross_entropy_masked(counts, model(spark, sf, lam), group=("grp_id",), unseen_ctx_prob=unseen)
    names = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.floor(F.col("grp_id") / N_BATCHES) + 1).cast("int"))
    return ce.select(names.alias("split"), (F.col("grp_id") % N_BATCHES).alias("batch_id"), F.col("ce").alias("loss"))


def _sql_batch_losses(model_name: str, unseen: str) -> str:
    return _sql_scored(model_name, unseen, "TRUE", "split, batch_id") + """,
bl AS (SELECT split, batch_id, sum(cnt * nll) / (sum(cnt) + 1e-9) AS loss FROM sc GROUP BY split, batch_id)"""


@query(
    "eval_loss_mean",
    sql=SQL_BASE + _sql_batch_losses("m1", "1.0::DOUBLE / 256")
    + " SELECT split, round(avg(loss), 6) AS loss, count(*) AS n_batches FROM bl GROUP BY split",
)
def q_eval_loss_mean(spark, sf):
    m = loss.eval_loss_mean(batch_losses(spark, sf, 1.0))
    return m.select("split", F.round("loss", 6).alias("loss"), "n_batches")


@query(
    "eval_loss_robust",
    sql=SQL_BASE + _sql_batch_losses("m0", "0.0::DOUBLE")
    + """ SELECT split, round(coalesce(quantile_disc(CASE WHEN loss < 'inf'::DOUBLE THEN loss END, 0.5), 'inf'::DOUBLE), 6) AS loss,
  count(CASE WHEN loss < 'inf'::DOUBLE THEN loss END) AS n_finite, count(*) AS n_batches FROM bl GROUP BY split""",
)
def q_eval_loss_robust(spark, sf):
    """Unsmoothed (maximum-likelihood) model: unseen transitions give infinite batch losses."""
    m = loss.eval_loss_robust(batch_losses(spark, sf, 0.0))
    return m.select("split", F.round("loss", 6).alias("loss"), "n_finite", "n_batches")


@query(
    "best_so_far",
    sql=SQL_BASE + _sql_batch_losses("m1", "1.0::DOUBLE / 256")
    + """, pv AS (SELECT split, batch_id, loss, min(loss) OVER (PARTITION BY split ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM bl)
SELECT split, batch_id, round(loss, 6) AS loss, (prev IS NULL OR loss < prev) AS new_best,
  round(CASE WHEN prev IS NULL THEN loss ELSE least(loss, prev) END, 6) AS best FROM pv""",
)
def q_best_so_far(spark, sf):
    """Batch losses read as an evaluation history (step = batch) per split."""
    b = loss.best_so_far(batch_losses(spark, sf, 1.0), "split", "batch_id", "loss")
    return b.select("split", "batch_id", F.round("loss", 6).alias("loss"), "new_best", F.round("best", 6).alias("best"))


@query(
    "kl_between",
    sql=SQL_BASE
    + """, vc AS (SELECT ctx, next, count(*) AS cnt FROM bg WHERE split = 'val' GROUP BY ctx, next),
vt AS (SELECT ctx, sum(cnt) AS ctx_total FROM vc GROUP BY ctx),
vg AS (SELECT vt.ctx, CAST(r.range AS INTEGER) AS next, vt.ctx_total, coalesce(vc.cnt, 0) AS cnt
       FROM vt CROSS JOIN range(256) r LEFT JOIN vc ON vc.ctx = vt.ctx AND vc.next = CAST(r.range AS INTEGER)),
q AS (SELECT ctx, next, (cnt + 1.0::DOUBLE) / (ctx_total + 256.0::DOUBLE) AS prob FROM vg),
k AS (SELECT m1.ctx, sum(q.prob * (ln(q.prob) - ln(m1.prob))) AS kl FROM m1 JOIN q ON q.ctx = m1.ctx AND q.next = m1.next GROUP BY m1.ctx)
SELECT count(*) AS n_ctx, round(avg(kl), 6) AS kl_mean, round(avg(kl) * 0.1, 6) AS kl_penalty FROM k""",
)
def q_kl_between(spark, sf):
    """KL(ref || policy): policy = train model, ref = model counted on the validation split."""
    val = split_docs(spark, sf).where(F.col("split") == "val")
    ref = ngram.ngram_probs(ngram.ngram_counts(val, "text", 1), 1.0)
    k = loss.kl_between(model(spark, sf), ref, 0.1)
    return k.select("n_ctx", F.round("kl_mean", 6).alias("kl_mean"), F.round("kl_penalty", 6).alias("kl_penalty"))


@query(
    "doc_perplexity",
    sql=SQL_BASE + _sql_scored("m1", "1.0::DOUBLE / 256", "TRUE", "doc_id")
    + """ SELECT doc_id, CAST(sum(cnt) AS BIGINT) AS n_tokens, round(exp(sum(cnt * nll) / (sum(cnt) + 1e-9)), 6) AS perplexity FROM sc GROUP BY doc_id""",
)
def q_doc_perplexity(spark, sf):
    p = al.doc_perplexity(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", al.dense_model(model(spark, sf)))
    return p.select("doc_id", "n_tokens", F.round("perplexity", 6).alias("perplexity"))
