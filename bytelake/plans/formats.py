"""Pair extraction and record formatting over ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AUGMENT_ANSWER, AUGMENT_THINKING, SHORT_SYSTEM_PROMPT
from ..functions.rng import u01_sql
from ..operators import formatting
from .registry import query, table
from .splits import SQL_PAIRS, pairs

SQL_Q = f"'{SHORT_SYSTEM_PROMPT}' || chr(10) || chr(10) || 'Question: '"


@query("pair_turns", sql=SQL_PAIRS)
def q_pair_turns(spark, sf):
    return pairs(spark, sf)


@query(
    "scan_pairs",
    sql=f"SELECT pair_id, octet_length(encode(prompt)) AS prompt_bytes, octet_length(encode(response)) AS response_bytes FROM ({SQL_PAIRS})",
)
def q_scan_pairs(spark, sf):
    p = pairs(spark, sf)
    return p.select(
        "pair_id",
        F.octet_length("prompt").cast("long").alias("prompt_bytes"),
        F.octet_length("response").cast("long").alias("response_bytes"),
    )


@query("format_generation_prompt", sql=f"SELECT pair_id, hex(encode({SQL_Q} || prompt)) || 'FE' AS context_hex FROM ({SQL_PAIRS})")
def q_format_generation_prompt(spark, sf):
    d = formatting.format_generation_prompt(pairs(spark, sf), "prompt")
    return d.select("pair_id", F.hex("context").alias("context_hex"))


@query(
    "format_sft_record",
    sql=f"SELECT pair_id, hex(encode({SQL_Q} || prompt || chr(254) || response || chr(255))) AS record_hex FROM ({SQL_PAIRS})",
)
def q_format_sft_record(spark, sf):
    d = formatting.format_sft_record(pairs(spark, sf), marker="char")
    return d.select("pair_id", F.hex("record").alias("record_hex"))


@query(
    "format_sft_record_byte",
    sql=f"SELECT pair_id, hex(encode({SQL_Q} || prompt)) || 'FE' || hex(encode(response)) || 'FF' AS record_hex FROM ({SQL_PAIRS})",
)
def q_format_sft_record_byte(spark, sf):
    d = formatting.format_sft_record(pairs(spark, sf), marker="byte")
    return d.select("pair_id", F.hex("record").alias("record_hex"))


@query(
    "augment_prompt_mix",
    sql=f"""SELECT doc_id, CASE WHEN {u01_sql(42, "'augment'", 'doc_id')} < 0.2::DOUBLE
  THEN {SQL_Q} || text || chr(10) || chr(10) || chr(254) || '<think>{AUGMENT_THINKING}</think><answer>{AUGMENT_ANSWER}</answer>' || chr(255)
  ELSE text END AS text FROM documents""",
)
def q_augment_prompt_mix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return formatting.augment_prompt_mix(d, "doc_id", "text", 0.2, 42)
