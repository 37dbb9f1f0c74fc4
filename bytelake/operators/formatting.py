"""Record formatting: pairs from turns, prompts, SFT records, template mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AUGMENT_ANSWER, AUGMENT_THINKING, BOS, EOS, SHORT_SYSTEM_PROMPT, THINK_END_TAG, THINK_TAG, ANSWER_END_TAG, ANSWER_TAG
from ..functions.binary import bos_bin, eos_bin, utf8
from ..functions.rng import u01

TURNS_PER_BUCKET = 4096


def next_turns(conv: DataFrame) -> DataFrame:
    """Each turn with the following one of its conversation as ``next`` (turn, role, text; null after the last).

    Turns are looked up inside buckets of turn numbers; the first turn of each bucket (a table smaller by the bucket size)
    serves the last turn of the bucket before it, so a very long conversation is not one task.
    """
    x = conv.where(F.col("turn").isNotNull()).select("conv_id", "turn", "role", "text")
    x = x.withColumn("__b", F.floor(F.col("turn") / TURNS_PER_BUCKET)).withColumn("__t", F.struct("turn", "role", "text"))
    inside = Window.partitionBy("conv_id", "__b").orderBy("turn")
    heads = x.groupBy("conv_id", "__b").agg(F.min("__t").alias("__head"))
    heads = heads.select("conv_id", "__b", F.lead("__head").over(Window.partitionBy("conv_id").orderBy("__b")).alias("__after"))
    x = x.withColumn("__in", F.lead("__t").over(inside)).join(heads, ["conv_id", "__b"], "left")
    return x.withColumn("next", F.coalesce("__in", "__after")).drop("__b", "__t", "__in", "__after")


def pair_key() -> Column:
    """``conv_id:turn``: one key per turn, whatever the numbers."""
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def pair_turns(conv: DataFrame) -> DataFrame:
    """``(pair_id, prompt, response)``: each user turn whose next turn (numbers may have gaps) is the assistant's."""
    x = next_turns(conv).where((F.col("role") == "user") & (F.col("next.role") == "assistant"))
    return x.select(pair_key().alias("pair_id"), F.col("text").alias("prompt"), F.col("next.text").alias("response"))


def question_prompt(col: str = "prompt", system: str = SHORT_SYSTEM_PROMPT):
    return F.concat(F.lit(system + "\n\nQuestion: "), F.col(col))


def format_generation_prompt(df: DataFrame, col: str = "prompt", system: str = SHORT_SYSTEM_PROMPT, out: str = "context") -> DataFrame:
    """``system + "\\n\\nQuestion: " + prompt`` as UTF-8 bytes followed by the BOS byte."""
    return df.withColumn(out, F.concat(utf8(question_prompt(col, system)), bos_bin()))


def format_sft_record(df: DataFrame, prompt: str = "prompt", response: str = "response", system: str = SHORT_SYSTEM_PROMPT, marker: str = "char", out: str = "record") -> DataFrame:
    """Question + BOS + response + EOS as bytes.

    ``marker='char'`` inserts the characters U+00FE/U+00FF before encoding (C3BE/C3BF, the
    reference behaviour); ``marker='byte'`` inserts the raw bytes FE/FF.
    """
    q = question_prompt(prompt, system)
    if marker == "char":
        rec = utf8(F.concat(q, F.lit(chr(BOS)), F.col(response), F.lit(chr(EOS))))
    elif marker == "byte":
        rec = F.concat(utf8(q), bos_bin(), utf8(response), eos_bin())
    else:
        raise ValueError("marker must be 'char' or 'byte'")
    return df.withColumn(out, rec)


def augment_prompt_mix(df: DataFrame, key: str, col: str = "text", p: float = 0.2, seed: int = 42, system: str = SHORT_SYSTEM_PROMPT, out: str | None = None) -> DataFrame:
    """About ``p`` of the rows wrapped in the question/think/answer template, the rest kept raw."""
    templ = F.concat(
        F.lit(system + "\n\nQuestion: "),
        F.col(col),
        F.lit("\n\n" + chr(BOS) + THINK_TAG + AUGMENT_THINKING + THINK_END_TAG + ANSWER_TAG + AUGMENT_ANSWER + ANSWER_END_TAG + chr(EOS)),
    )
    return df.withColumn(out or col, F.when(u01(seed, F.lit("augment"), key) < p, templ).otherwise(F.col(col)))
