"""Corpus scans, cleaning and byte statistics over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import WeightConfig
from ..operators import clean, stats
from ..sources import parquet as src
from .registry import query, table

R9, R6 = 9, 6

# DuckDB: one row per byte of every document (hex pairs of the UTF-8 encoding)
SQL_BYTES = "SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS hx FROM documents WHERE text IS NOT NULL"
SQL_HIST = f"""
WITH b AS ({SQL_BYTES}),
c AS (SELECT CAST(('0x' || hx) AS INTEGER) AS byte, count(*) AS cnt FROM b GROUP BY 1),
ids AS (SELECT CAST(range AS INTEGER) AS byte FROM range(256))
SELECT ids.byte, CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt FROM ids LEFT JOIN c USING (byte)
"""
SQL_FREQ = f"""
WITH h AS ({SQL_HIST}),
f AS (SELECT byte, cnt, greatest(CASE WHEN sum(cnt) OVER () > 0 THEN cnt::DOUBLE / (sum(cnt) OVER ())::DOUBLE
                                     ELSE 1.0::DOUBLE / 256 END, 1e-5::DOUBLE) AS freq FROM h),
w AS (SELECT byte, cnt, freq, least(pow(1.0::DOUBLE / freq, 0.5::DOUBLE), 10.0::DOUBLE) AS w FROM f)
"""


def corpus(spark, sf):
    """documents -> (doc_id, text) with the content column detected by name."""
    return src.select_content(table(spark, sf, "documents"), key="doc_id")


def weights_table(spark, sf, cfg: WeightConfig = WeightConfig()):
    d = clean.string_guard(corpus(spark, sf), "text")
    hist = stats.byte_histogram(d, "text")
    freq = stats.token_frequencies(hist, cfg.min_freq)
    return stats.token_weights(freq, cfg.alpha, cfg.max_weight)


@query("token_weights", sql=SQL_FREQ + "SELECT byte, cnt, round(freq, 9) AS freq, round(w * 256 / sum(w) OVER (), 6) AS weight FROM w")
def q_token_weights(spark, sf):
    """Flagship: how rare is each byte and how much should it weigh in the loss (256 rows)."""
    return weights_table(spark, sf).select(
        "byte", "cnt", F.round("freq", R9).alias("freq"), F.round("weight", R6).alias("weight")
    )


@query("byte_histogram", sql=SQL_HIST)
def q_byte_histogram(spark, sf):
    return stats.byte_histogram(clean.string_guard(corpus(spark, sf), "text"), "text")


@query("token_frequencies", sql=SQL_FREQ + "SELECT byte, cnt, round(freq, 9) AS freq FROM f")
def q_token_frequencies(spark, sf):
    hist = stats.byte_histogram(clean.string_guard(corpus(spark, sf), "text"), "text")
    return stats.token_frequencies(hist).select("byte", "cnt", F.round("freq", R9).alias("freq"))


@query(
    "max_frequency",
    sql=SQL_FREQ + "SELECT arg_min(byte, (-freq, byte)) AS top_byte, round(max(freq), 9) AS top_freq FROM f",
)
def q_max_frequency(spark, sf):
    hist = stats.byte_histogram(clean.string_guard(corpus(spark, sf), "text"), "text")
    m = stats.max_frequency(stats.token_frequencies(hist))
    return m.select("top_byte", F.round("top_freq", R9).alias("top_freq"))


@query("scan_corpus_glob", sql="SELECT doc_id, text FROM documents")
def q_scan_corpus_glob(spark, sf):
    df = src.scan_corpus_glob(spark, f"{sf.rstrip('/')}/documents*.parquet")
    return src.select_content(df, key="doc_id")


@query("detect_content_column", sql="SELECT 'text' AS content_column, count(text) AS n_values FROM documents")
def q_detect_content_column(spark, sf):
    df = table(spark, sf, "documents")
    c = src.detect_content_column(df)
    return df.agg(F.lit(c).alias("content_column"), F.count(F.col(c)).alias("n_values"))


@query(
    "corpus_profile",
    sql="""SELECT count(*) AS n_rows, CAST(count_if(doc_id IS NULL) AS BIGINT) AS nulls_doc_id, CAST(count_if(text IS NULL) AS BIGINT) AS nulls_text,
       CAST(count_if(lang IS NULL) AS BIGINT) AS nulls_lang, CAST(count_if(source IS NULL) AS BIGINT) AS nulls_source,
       CAST(count_if(n_chars IS NULL) AS BIGINT) AS nulls_n_chars FROM documents""",
)
def q_corpus_profile(spark, sf):
    return src.corpus_profile(table(spark, sf, "documents"))


@query("corpus_head", sql="SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def q_corpus_head(spark, sf):
    return src.head_sample(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id", 5)


@query("drop_null_text", sql="SELECT doc_id, lang FROM documents WHERE text IS NOT NULL")
def q_drop_null_text(spark, sf):
    return clean.drop_null_text(table(spark, sf, "documents").select("doc_id", "lang", "text"), "text").select("doc_id", "lang")


# DuckDB twin of the blank rule: strip Unicode white space and U+001C..U+001F
SQL_NONBLANK = "regexp_matches(text, '[^\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')"


@query(
    "drop_blank_text",
    sql=f"""SELECT lang, count(*) AS n_kept FROM documents
WHERE text IS NOT NULL AND {SQL_NONBLANK} GROUP BY lang""",
)
def q_drop_blank_text(spark, sf):
    d = clean.drop_blank_text(table(spark, sf, "documents").select("lang", "text"), "text")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"))


@query("string_guard", sql="SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents WHERE text IS NOT NULL")
def q_string_guard(spark, sf):
    d = clean.string_guard(corpus(spark, sf), "text")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query(
    "placeholder_if_empty",
    sql="""WITH k AS (SELECT 'all' AS corpus, doc_id, text FROM documents WHERE text IS NOT NULL),
e AS (SELECT 'none' AS corpus, doc_id, text FROM documents WHERE text IS NOT NULL AND n_chars > 1000000000)
SELECT corpus, doc_id, text FROM k UNION ALL SELECT 'all', NULL::BIGINT, 'This is a placeholder text.' WHERE (SELECT count(*) FROM k) = 0
UNION ALL SELECT corpus, doc_id, text FROM e UNION ALL SELECT 'none', NULL::BIGINT, 'This is a placeholder text.' WHERE (SELECT count(*) FROM e) = 0""",
)
def q_placeholder_if_empty(spark, sf):
    """The corpus, which passes through, and an emptied one (documents over a billion characters: none here), which
    becomes the placeholder row."""
    docs = table(spark, sf, "documents")
    kept = clean.placeholder_if_empty(clean.string_guard(docs.select("doc_id", "text"), "text"), "text")
    none = docs.where(F.col("n_chars") > 1_000_000_000).select("doc_id", "text")
    none = clean.placeholder_if_empty(clean.string_guard(none, "text"), "text")
    return kept.withColumn("corpus", F.lit("all")).unionByName(none.withColumn("corpus", F.lit("none")))


@query("take_prefix", sql="SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def q_take_prefix(spark, sf):
    return clean.take_prefix(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), 100, "doc_id")


@query("preview", sql="SELECT doc_id, substring(text, 1, 100) AS preview FROM documents")
def q_preview(spark, sf):
    return clean.preview(corpus(spark, sf), "text", 100, out="preview").select("doc_id", "preview")


@query(
    "special_token_audit",
    sql="""SELECT lang, count(*) AS n_docs,
  CAST(count_if(strpos(text, chr(254)) > 0) AS BIGINT) AS n_bos_char,
  CAST(count_if(strpos(text, chr(255)) > 0) AS BIGINT) AS n_eos_char,
  CAST(count_if(strpos(text, chr(0)) > 0) AS BIGINT) AS n_nul,
  CAST(0 AS BIGINT) AS n_invalid_utf8
FROM documents GROUP BY lang""",
)
def q_special_token_audit(spark, sf):
    return stats.special_token_audit(table(spark, sf, "documents"), "text", "lang")
