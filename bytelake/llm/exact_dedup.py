"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Rows are first grouped by byte length, then by a 64-bit hash of a short prefix; the SHA-256 of the
whole text is taken only for rows whose (length, prefix hash) is shared by at least two rows.  Every
step shuffles narrow keys with map-side counts, so a group holding a third of all rows is one partial
count per task.  Texts stay where they are read as long as the keys of the surviving groups number at most
``SMALL_ROWS`` (they are written and counted, then broadcast); beyond that the joins are shuffles, which Spark's skew
handling may split.

Defined results: a null text counts as empty; equal rows (same id, same text) form one group of which
one row stays; a null id is the smallest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored, text_or_empty
from .registry import query, table

PREFIX_CHARS = 64


def _keyed(docs: DataFrame, text: str, prefix_chars: int) -> list:
    body = text_or_empty(text)
    return [F.octet_length(body).alias("_n"), F.xxhash64(F.substring(body, 1, prefix_chars)).alias("_p")]


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``(_n, _p, _sha, keep_id, group_size)`` of every text that occurs at least twice."""
    rows = docs.select(*_keyed(docs, text, prefix_chars))
    by_length = rows.groupBy("_n").count().filter("count > 1").select("_n")
    by_prefix = rows.join(by_length, "_n", "left_semi").groupBy("_n", "_p").count().filter("count > 1").select("_n", "_p")
    by_prefix = small(stored(by_prefix, "shared-prefixes"))
    body = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_t"), *_keyed(docs, text, prefix_chars))
    full = body.join(by_prefix, ["_n", "_p"], "left_semi").select("_id", "_n", "_p", F.sha2("_t", 256).alias("_sha"))
    groups = full.groupBy("_n", "_p", "_sha").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return stored(groups.filter("group_size > 1"), "duplicate-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per document: ``(id, keep_id, group_size, kept, text_sha256)``; the largest id stays.

    Of rows that agree in id and text, the one first in the written key table stays."""
    body = text_or_empty(text)
    rows = docs.select(F.col(id_col), *_keyed(docs, text, prefix_chars), F.sha2(body, 256).alias("_sha"), F.monotonically_increasing_id().alias("_row"))
    rows = stored(rows, "dedup-keys")
    groups = duplicate_groups(docs, id_col, text, prefix_chars)
    joined = rows.join(groups, ["_n", "_p", "_sha"], "left")
    alone = F.col("group_size").isNull()
    best = F.col(id_col).eqNullSafe(F.col("keep_id"))
    # of equal rows with the id that stays, the smallest row number stays (one row in most groups)
    first = joined.filter(~alone & best).groupBy("_sha").agg(F.min("_row").alias("_first"))
    out = joined.join(first, "_sha", "left")
    return out.select(
        id_col,
        F.when(alone, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.coalesce(F.col("_first"), F.lit(-1)))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.  The full hash is taken only for rows
    whose (length, prefix hash) belongs to a duplicate group."""
    groups = duplicate_groups(docs, id_col, text, prefix_chars).withColumnRenamed("keep_id", "_keep").withColumnRenamed("group_size", "_size")
    prefixes = small(stored(groups.select("_n", "_p").distinct().withColumn("_shared", F.lit(True)), "duplicate-prefixes"))
    # the row travels as one struct, so its own column names can't clash with the keys
    keyed = docs.select(F.struct("*").alias("_doc"), *_keyed(docs, text, prefix_chars)).join(prefixes, ["_n", "_p"], "left")
    keyed = keyed.withColumn("_sha", F.when(F.col("_shared"), F.sha2(text_or_empty(f"_doc.{text}"), 256)).otherwise(F.hex("_p")))
    joined = keyed.join(small(groups).select("_sha", "_keep", "_size"), "_sha", "left")
    alone = joined.filter(F.col("_size").isNull()).select("_doc.*")
    winners = joined.filter(F.col("_size").isNotNull() & F.col(f"_doc.{id_col}").eqNullSafe(F.col("_keep")))
    return alone.unionByName(winners.dropDuplicates(["_sha"]).select("_doc.*"))


@query(
    "op1_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op1(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
