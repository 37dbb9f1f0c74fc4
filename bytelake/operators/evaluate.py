"""Tag extraction and evaluation summaries over generated texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ANSWER_END_TAG, ANSWER_TAG, THINK_END_TAG, THINK_TAG


def tag_positions(df: DataFrame, col: str = "generated") -> DataFrame:
    """0-based first index of each tag (-1 when absent), in characters."""
    t = F.col(col)
    return (
        df.withColumn("think_start", F.instr(t, THINK_TAG) - 1)
        .withColumn("think_end", F.instr(t, THINK_END_TAG) - 1)
        .withColumn("answer_start", F.instr(t, ANSWER_TAG) - 1)
        .withColumn("answer_end", F.instr(t, ANSWER_END_TAG) - 1)
    )


def tag_flags(df: DataFrame) -> DataFrame:
    """``has_thinking``/``has_answer``: the opening tag occurs and the first closing tag comes after it."""
    return df.withColumn("has_thinking", (F.col("think_start") >= 0) & (F.col("think_end") > F.col("think_start"))).withColumn(
        "has_answer", (F.col("answer_start") >= 0) & (F.col("answer_end") > F.col("answer_start"))
    )


def tag_spans(df: DataFrame, col: str = "generated", cap: int | None = None) -> DataFrame:
    """Section text from the opening tag through the closing tag; with ``cap`` at most so many characters."""
    t = F.col(col)

    def span(s, e, tag_len, flag):
        stop = F.col(e) + tag_len if cap is None else F.least(F.col(e) + tag_len, F.col(s) + cap)
        return F.when(F.col(flag), F.substring(t, F.col(s) + 1, stop - F.col(s)))

    return df.withColumn("think_span", span("think_start", "think_end", len(THINK_END_TAG), "has_thinking")).withColumn(
        "answer_span", span("answer_start", "answer_end", len(ANSWER_END_TAG), "has_answer")
    )


def evaluation_table(sampled: DataFrame, completions: DataFrame, scores: DataFrame, key: str = "pair_id") -> DataFrame:
    """Result rows: sampled prompts/references joined with completions (inner) and scores (left)."""
    j = sampled.join(completions, key).join(scores, key, "left")
    return tag_flags(tag_positions(j, "generated"))


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Thinking rate, answer rate, mean generation time, mean reward (only when no score is null)."""
    n = F.count(F.lit(1))
    return results.agg(
        n.alias("n_examples"),
        F.avg(F.col("has_thinking").cast("int")).alias("thinking_rate"),
        F.avg(F.col("has_answer").cast("int")).alias("answer_rate"),
        F.avg("generation_time").alias("avg_generation_time"),
        F.when(n == F.count("reward_score"), F.avg("reward_score")).alias("avg_reward"),
    )
