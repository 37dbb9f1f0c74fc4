"""Byte tokens, decoding, offsets, blocks and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.binary import eos_bin, utf8
from ..functions.rng import u01_sql
from ..operators import blocks, formatting, split, stats, tokens
from .fixtures import SQL_COMPLETIONS, completions
from .formats import SQL_Q
from .registry import query, table
from .splits import SQL_PAIRS, pairs

SEED = 42
BLOCK = 1024
U_DOC = u01_sql(SEED, "'split3'", "doc_id")


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


@query("utf8_bytes", sql="SELECT doc_id, hex(encode(text)) AS bytes_hex FROM documents")
def q_utf8_bytes(spark, sf):
    d = tokens.utf8_bytes(docs(spark, sf), "text")
    return d.select("doc_id", F.hex("bytes").alias("bytes_hex"))


@query(
    "utf8_token_table",
    sql="""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS hx FROM documents)
SELECT doc_id, count(*) AS n_tokens, CAST(sum(CAST(('0x' || hx) AS INTEGER)) AS BIGINT) AS byte_sum FROM t GROUP BY doc_id""",
)
def q_utf8_token_table(spark, sf):
    t = tokens.token_table(tokens.utf8_bytes(docs(spark, sf), "text"), "doc_id")
    return t.groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum("byte").cast("long").alias("byte_sum")
    )


# every document's whole bytes, and as extra rows its first half: cuts inside characters give malformed tails
SQL_HALF = "unhex(left(hex(encode(text)), 2 * CAST(floor(octet_length(encode(text)) * 0.5::DOUBLE) AS BIGINT)))"
SQL_HALF_HEX = "left(hex(encode(text)), 2 * CAST(floor(octet_length(encode(text)) * 0.5::DOUBLE) AS BIGINT))"


def whole_and_half_bytes(spark, sf):
    """Two rows per document: all of its bytes, and the first half of them."""
    half = F.expr("substring(encode(text, 'UTF-8'), 1, CAST(floor(octet_length(text) * 0.5D) AS INT))")
    return docs(spark, sf).select("doc_id", "lang", F.explode(F.array(utf8("text"), half)).alias("bytes"))


@query(
    "decode_replace",
    sql=f"""WITH h AS (SELECT lang, hex(encode(text)) AS hx FROM documents UNION ALL SELECT lang, {SQL_HALF_HEX} FROM documents)
SELECT lang, count(*) AS n_rows, CAST(count_if(try(decode(unhex(hx))) IS NULL) AS BIGINT) AS n_repaired,
  CAST(sum(len(list_filter(regexp_extract_all(hx, '..'), lambda x: x[1] NOT IN ('8', '9', 'A', 'B')))) AS BIGINT) AS n_chars
FROM h GROUP BY lang""",
)
def q_decode_replace(spark, sf):
    d = tokens.decode_replace(whole_and_half_bytes(spark, sf), "bytes", "text")
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("repaired").alias("n_repaired"),
        F.sum(F.char_length("text")).cast("long").alias("n_chars"),
    )


@query(
    "decode_strict_or_message",
    sql=f"""WITH h AS (SELECT lang, text AS t FROM documents UNION ALL SELECT lang, try(decode({SQL_HALF})) FROM documents)
SELECT lang, count(*) AS n_rows, CAST(count_if(t IS NOT NULL) AS BIGINT) AS n_decoded,
  CAST(sum(length(coalesce(t, 'Error: Unable to decode generated response.'))) AS BIGINT) AS n_chars
FROM h GROUP BY lang""",
)
def q_decode_strict_or_message(spark, sf):
    d = tokens.decode_strict_or_message(whole_and_half_bytes(spark, sf), "bytes", "text")
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("decoded").alias("n_decoded"),
        F.sum(F.char_length("text")).cast("long").alias("n_chars"),
    )


@query(
    "encoding_audit",
    sql="""SELECT lang, source, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes,
  CAST(count_if(octet_length(encode(text)) > length(text)) AS BIGINT) AS n_multibyte_rows,
  round(1.0::DOUBLE - sum(length(text))::DOUBLE / sum(octet_length(encode(text)))::DOUBLE, 6) AS multibyte_share,
  CAST(0 AS BIGINT) AS n_invalid
FROM documents GROUP BY lang, source""",
)
def q_encoding_audit(spark, sf):
    return tokens.encoding_audit(docs(spark, sf), "text", ("lang", "source"))


SQL_DOC_SPLIT = f"""WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY {U_DOC}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
c AS (SELECT doc_id, text, pos, n, ceil(0.2::DOUBLE * n) AS n_hold FROM r),
ds AS (SELECT doc_id, text, CASE WHEN pos < n - n_hold THEN 'train'
                  WHEN pos < n - n_hold + (n_hold - ceil(0.5::DOUBLE * n_hold)) THEN 'val' ELSE 'test' END AS split FROM c)"""


@query(
    "corpus_byte_totals",
    sql=SQL_DOC_SPLIT + "\nSELECT CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM ds GROUP BY ROLLUP (split)",
)
def q_corpus_byte_totals(spark, sf):
    d = split.split_three_way(docs(spark, sf), "doc_id", 0.2, 0.5, SEED)
    return tokens.corpus_byte_totals(d, "text", "split")


@query(
    "stream_offsets",
    sql="""SELECT doc_id, octet_length(encode(text)) AS n_bytes,
  CAST(coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_off,
  CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_off
FROM documents""",
)
def q_stream_offsets(spark, sf):
    return blocks.stream_offsets(docs(spark, sf), "doc_id", "text").select("doc_id", "n_bytes", "start_off", "end_off")


SQL_STREAM = "WITH s AS (SELECT string_agg(hex(encode(text)), '' ORDER BY doc_id) AS h FROM documents), l AS (SELECT h, length(h) // 2 AS n FROM s)"


SQL_OFFS = """WITH o AS (SELECT doc_id, hex(encode(text)) AS h,
    CAST(coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
    CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e FROM documents),
tot AS (SELECT max(e) AS n FROM o)"""


@query(
    "stream_blocks_packed",
    sql=SQL_OFFS
    + f""", g AS (SELECT range AS g FROM range(0, (SELECT (n - 1) // {BLOCK} FROM tot))),
pc AS (SELECT g.g, greatest(o.s, g.g * {BLOCK}) AS lo, least(o.e, g.g * {BLOCK} + {BLOCK + 1}) AS hi, o.h, o.s
       FROM g JOIN o ON o.s < g.g * {BLOCK} + {BLOCK + 1} AND o.e > g.g * {BLOCK}),
bl AS (SELECT g, string_agg(substr(h, CAST(2 * (lo - s) + 1 AS BIGINT), CAST(2 * (hi - lo) AS BIGINT)), '' ORDER BY lo) AS d FROM pc GROUP BY g)
SELECT g AS block_id, g * {BLOCK} AS start_off, substr(d, 1, {2 * BLOCK}) AS x_hex, substr(d, 3, {2 * BLOCK}) AS y_hex FROM bl""",
)
def q_stream_blocks_packed(spark, sf):
    d = docs(spark, sf)
    b = blocks.stream_blocks_packed(d, blocks.stream_offsets(d, "doc_id", "text"), "doc_id", "text", BLOCK)
    return b.select("block_id", "start_off", F.hex("x").alias("x_hex"), F.hex("y").alias("y_hex"))


@query(
    "stream_blocks_random",
    sql=SQL_STREAM
    + f""", d AS (SELECT range AS draw FROM range(512)),
st AS (SELECT draw, CAST(floor({u01_sql(SEED, "'blocks'", 'draw')} * (n - {BLOCK})) AS BIGINT) AS start_off, h FROM d, l)
SELECT draw, start_off, substr(h, 2 * start_off + 1, {2 * BLOCK}) AS x_hex, substr(h, 2 * start_off + 3, {2 * BLOCK}) AS y_hex FROM st""",
)
def q_stream_blocks_random(spark, sf):
    d = docs(spark, sf)
    offs = blocks.stream_offsets(d, "doc_id", "text")
    total = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).scalar()
    b = blocks.stream_blocks_random(d, offs, "doc_id", "text", BLOCK, 512, SEED, total=total)
    return b.select("draw", "start_off", F.hex("x").alias("x_hex"), F.hex("y").alias("y_hex"))


@query(
    "byte_histogram_sampled",
    sql=f"""WITH o AS (SELECT doc_id, hex(encode(text)) AS h,
    CAST(coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
    CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e FROM documents),
n AS (SELECT max(e) AS n FROM o),
p AS (SELECT CAST(floor({u01_sql(SEED, "'histogram'", 'id')} * n) AS BIGINT) AS pos FROM range(100000) d(id), n),
c AS (SELECT CAST(('0x' || substr(o.h, 2 * (p.pos - o.s) + 1, 2)) AS INTEGER) AS byte, count(*) AS cnt
      FROM p JOIN o ON p.pos >= o.s AND p.pos < o.e GROUP BY 1),
ids AS (SELECT CAST(range AS INTEGER) AS byte FROM range(256))
SELECT ids.byte, CAST(coalesce(c.cnt, 0) AS BIGINT) AS cnt FROM ids LEFT JOIN c USING (byte)""",
)
def q_byte_histogram_sampled(spark, sf):
    """Histogram of 100,000 byte positions drawn with replacement from the whole stream."""
    return stats.byte_histogram_sampled(docs(spark, sf), "doc_id", "text", 100_000, SEED)


SQL_REC = f"SELECT pair_id, encode({SQL_Q} || prompt || chr(254) || response || chr(255)) AS rec FROM ({SQL_PAIRS})"
SQL_WIN = f"""WITH r AS ({SQL_REC}), n AS (SELECT pair_id, hex(rec) AS h, octet_length(rec) AS n FROM r),
w AS (SELECT pair_id, CASE WHEN n > {BLOCK} THEN substr(h, 2 * CAST(floor({u01_sql(SEED, "'crop'", 'pair_id')} * (n - {BLOCK})) AS BIGINT) + 1, {2 * BLOCK})
                       ELSE rpad(h, {2 * BLOCK}, '0') END AS x_hex FROM n)"""


def windows(spark, sf):
    rec = formatting.format_sft_record(pairs(spark, sf), marker="char")
    return blocks.window_crop_or_pad(rec, "pair_id", "record", BLOCK, SEED, "x")


@query("window_crop_or_pad", sql=SQL_WIN + " SELECT pair_id, x_hex FROM w")
def q_window_crop_or_pad(spark, sf):
    return windows(spark, sf).select("pair_id", F.hex("x").alias("x_hex"))


@query("next_byte_target", sql=SQL_WIN + " SELECT pair_id, substr(x_hex, 3) || '00' AS y_hex FROM w")
def q_next_byte_target(spark, sf):
    return blocks.next_byte_target(windows(spark, sf), "x", "y").select("pair_id", F.hex("y").alias("y_hex"))


@query(
    "padding_mask_stats",
    sql=SQL_WIN + " SELECT pair_id, CAST(len(list_filter(regexp_extract_all(substr(x_hex, 3) || '00', '..'), lambda b: b <> '00')) AS INTEGER) AS n_valid FROM w",
)
def q_padding_mask_stats(spark, sf):
    y = blocks.next_byte_target(windows(spark, sf), "x", "y")
    return tokens.padding_mask_stats(y, "y", "n_valid").select("pair_id", F.col("n_valid").cast("int").alias("n_valid"))


@query(
    "batch_ids",
    sql=f"""WITH p AS ({SQL_PAIRS}), s AS (SELECT pair_id, row_number() OVER (ORDER BY {u01_sql(SEED, "'shuffle'", 'pair_id')}, pair_id) - 1 AS pos FROM p)
SELECT pair_id, pos, pos // 2 AS batch_id, pos // 16 AS accum_group FROM s""",
)
def q_batch_ids(spark, sf):
    s = split.shuffle_rows(pairs(spark, sf), "pair_id", SEED, "pos")
    return blocks.batch_ids(s, "pos", 2, 8).select("pair_id", "pos", "batch_id", "accum_group")


@query(
    "context_tail",
    sql=f"""WITH c AS (SELECT pair_id, hex(encode({SQL_Q} || prompt)) || 'FE' AS h FROM ({SQL_PAIRS}))
SELECT pair_id, right(h, least(length(h), 512)) AS tail_hex FROM c""",
)
def q_context_tail(spark, sf):
    """Last 256 bytes of each generation context."""
    c = formatting.format_generation_prompt(pairs(spark, sf), "prompt")
    return blocks.context_tail(c, "context", 256, "tail").select("pair_id", F.hex("tail").alias("tail_hex"))


@query(
    "strip_special",
    sql=f"""WITH r AS (SELECT pair_id, list_filter(regexp_extract_all(hex(encode({SQL_Q} || prompt)) || 'FE' || hex(encode(response)) || 'FF' || hex(encode(prompt)), '..'), lambda b: b <> 'FE') AS l FROM ({SQL_PAIRS}))
SELECT pair_id, array_to_string(CASE WHEN list_contains(l, 'FF') THEN list_slice(l, 1, list_position(l, 'FF') - 1) ELSE l END, '') AS stripped_hex FROM r""",
)
def q_strip_special(spark, sf):
    """Byte-form records followed by trailing text: BOS removed, everything from EOS on cut."""
    r = formatting.format_sft_record(pairs(spark, sf), marker="byte")
    r = r.withColumn("record", F.concat("record", utf8("prompt")))
    return tokens.strip_special(r, "record", "stripped").select("pair_id", F.hex("stripped").alias("stripped_hex"))


def _sql_bytepos(text, charpos):
    return f"(octet_length(encode(substring({text}, 1, {charpos} - 1))) + 1)"


NEVER = 4611686018427387904


@query(
    "stop_reason",
    sql=f"""WITH c AS (SELECT *, octet_length(encode(reference)) AS ref_len, octet_length(encode(completion)) AS n0, octet_length(encode(prompt)) AS np FROM ({SQL_COMPLETIONS})),
v AS (SELECT pair_id, 'plain' AS form, completion AS g, ref_len, n0 AS n, {NEVER} AS c_eos FROM c
      UNION ALL SELECT pair_id, 'eos', completion, ref_len, n0 + 1 + np, n0 + 1 FROM c
      UNION ALL SELECT pair_id, 'long', repeat(completion, 3), ref_len, 3 * n0, {NEVER} FROM c),
f AS (SELECT *, strpos(g, '</answer>') AS a FROM v),
k AS (SELECT pair_id, form, n, c_eos,
        CASE WHEN a > 0 AND strpos(substring(g, 1, a + 8), '</think>') > 0 THEN {_sql_bytepos('g', 'a')} + 8 ELSE {NEVER} END AS c_ans,
        CASE WHEN n >= least(4096, 2 * ref_len) THEN least(4096, 2 * ref_len) ELSE {NEVER} END AS c_lim FROM f)
SELECT pair_id, form,
  CASE WHEN least(c_eos, c_ans, c_lim) = {NEVER} THEN 'complete' WHEN c_eos <= least(c_ans, c_lim) THEN 'eos' WHEN c_ans <= c_lim THEN 'answer_end' ELSE 'max_length' END AS stop_reason,
  CAST(CASE WHEN least(c_eos, c_ans, c_lim) = {NEVER} THEN n ELSE least(c_eos, c_ans, c_lim) END AS BIGINT) AS stop_len
FROM k""",
)
def q_stop_reason(spark, sf):
    """Each completion as it is, with an EOS byte and text after it, and three times over, after its prompt's context."""
    c = formatting.format_generation_prompt(completions(spark, sf), "prompt").withColumn("ref_len", F.octet_length("reference"))
    forms = F.array(
        F.struct(F.lit("plain").alias("form"), utf8("completion").alias("bytes")),
        F.struct(F.lit("eos").alias("form"), F.concat(utf8("completion"), eos_bin(), utf8("prompt")).alias("bytes")),
        F.struct(F.lit("long").alias("form"), utf8(F.repeat("completion", F.lit(3))).alias("bytes")),
    )
    c = c.select("pair_id", "context", "ref_len", F.explode(forms).alias("v")).select("pair_id", "context", "ref_len", "v.*")
    return tokens.stop_reason(c, "bytes", "ref_len", "context").select("pair_id", "form", "stop_reason", "stop_len")
