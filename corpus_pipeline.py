"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's result as a
Parquet table in the shared folder and reads it back as the next stage's input.  All stages but the last
return the columns of ``documents``.

Defined results of every stage: null texts count as empty, repeated rows are separate documents (of equal
rows the dedup stages keep one), extra columns pass through, an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytelake.llm.bm25_decontamination import drop_contaminated
from bytelake.llm.common import stored
from bytelake.llm.crf_language import keep_identified
from bytelake.llm.exact_dedup import drop_exact_duplicates
from bytelake.llm.golay_simhash import keep_one_per_component
from bytelake.llm.packing import pack
from bytelake.llm.registry import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, mixed texts too; a null language becomes the best one.  Texts that are null or without letters go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays (3-word shingles, two bits)."""
    return keep_one_per_component(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two lengths, with their ids."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Language ID, SimHash and the tokenizer can't be expressed in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
