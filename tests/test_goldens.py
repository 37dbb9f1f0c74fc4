"""Hand-made edge frames with expected values (one per quirk)."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from bytelake.functions.binary import utf8
from bytelake.operators import blocks, clean, evaluate, formatting, loss, nucleus, rewards, stats, tokens


def _rewards(spark, gen, ref, scale):
    df = spark.createDataFrame([Row(k=1, g=gen, r=ref, s=float(scale))]).withColumn("g", utf8("g")).withColumn("r", utf8("r"))
    arr = rewards.with_reward_array(df, "g", "r", F.col("s"), "rw").select("rw").first()[0]
    feat = rewards.total_reward(rewards.match_features(df, "g", "r"), "s").first()
    long = [x.reward for x in rewards.token_rewards(df, ["k"], "g", "r", F.col("s")).orderBy("pos").collect()]
    return arr, feat, long


@pytest.mark.parametrize(
    "gen,ref,scale,expected",
    [
        ("ab", "ab", 1, [0.1, 0.55]),
        ("ax", "ab", 1, [0.1, 0.0]),
        ("a", "ab", 2, [-0.4]),
        ("", "ab", 1, [-0.5]),
        ("abc", "ab", 1, [0.1, 0.4]),
        ("", "", 1, []),
    ],
)
def test_reward_cases(spark, gen, ref, scale, expected):
    arr, feat, long = _rewards(spark, gen, ref, scale)
    assert arr == pytest.approx(expected)
    assert long == pytest.approx(expected)
    assert feat.total_reward == pytest.approx(sum(expected))
    assert feat.n_rewards == len(expected)
    assert feat.mean_reward == pytest.approx(sum(expected) / len(expected) if expected else 0.0)


def test_penalty_schedule(spark):
    df = spark.createDataFrame([Row(ep=0, n=100), Row(ep=99, n=100), Row(ep=0, n=1)])
    got = [r.s for r in df.select(rewards.penalty_scale("ep", F.col("n"), 2.5).alias("s")).collect()]
    assert got == pytest.approx([1.0, 2.5, 1.0])


def test_scale_bucket(spark):
    df = spark.createDataFrame([Row(s=x) for x in (1.0, 1.1, 2.3, 3.5, 9.9)])
    assert [r.b for r in df.select(rewards.scale_bucket("s").alias("b")).collect()] == [0, 1, 12, 24, 24]


def test_markers(spark):
    df = spark.createDataFrame([Row(prompt="", response="")])
    c = formatting.format_sft_record(df, marker="char", system="").select(F.hex("record")).first()[0]
    b = formatting.format_sft_record(df, marker="byte", system="").select(F.hex("record")).first()[0]
    q = "0A0A5175657374696F6E3A20"  # "\n\nQuestion: "
    assert c == q + "C3BE" + "C3BF"
    assert b == q + "FE" + "FF"


def test_decode_replace_and_strict(spark):
    df = spark.createDataFrame([Row(h="616263FEFF64"), Row(h="C3"), Row(h="616263")]).withColumn("bytes", F.unhex("h"))
    rep = [r.text for r in tokens.decode_replace(df, "bytes").select("text").collect()]
    assert rep[0] == "abc��d"
    assert rep[1] == "�"
    strict = tokens.decode_strict_or_message(df, "bytes").collect()
    assert strict[1].text == "Error: Unable to decode generated response." and not strict[1].decoded
    assert strict[2].text == "abc" and strict[2].decoded


def test_pad_and_shift(spark):
    df = spark.createDataFrame([Row(k=1, t="abcd")]).withColumn("b", utf8("t"))
    w = blocks.window_crop_or_pad(df, "k", "b", block=6, out="x")
    y = blocks.next_byte_target(w, "x", "y").select(F.hex("x"), F.hex("y")).first()
    assert tuple(y) == ("616263640000", "626364000000")


def test_crop_start_always_zero(spark):
    rows = [Row(k=i, t="abcdefg") for i in range(50)]  # length block + 1 with block 6
    df = spark.createDataFrame(rows).withColumn("b", utf8("t"))
    xs = {r[0] for r in blocks.window_crop_or_pad(df, "k", "b", block=6, out="x").select(F.hex("x")).collect()}
    assert xs == {"616263646566"}


def test_strip_special(spark):
    df = spark.createDataFrame([Row(h="61FE62FF63")]).withColumn("b", F.unhex("h"))
    assert tokens.strip_special(df, "b", "o").select(F.hex("o")).first()[0] == "6162"


def test_top_p(spark):
    df = spark.createDataFrame([Row(g=1, i=1, p=0.5), Row(g=1, i=2, p=0.3), Row(g=1, i=3, p=0.2), Row(g=2, i=1, p=0.9), Row(g=2, i=2, p=0.1)])
    g1 = {r.i: r.prob for r in nucleus.top_p_filter(df.where("g = 1"), "g", "i", "p", 0.6).collect()}
    assert g1 == pytest.approx({1: 0.625, 2: 0.375})
    g2 = {r.i: r.prob for r in nucleus.top_p_filter(df.where("g = 2"), "g", "i", "p", 0.6).collect()}
    assert g2 == pytest.approx({1: 1.0})


def test_robust_eval(spark):
    inf = float("inf")
    df = spark.createDataFrame([Row(split="a", loss=x) for x in (1.0, 2.0, 3.0, 4.0, inf)] + [Row(split="b", loss=inf), Row(split="b", loss=inf)])
    got = {r.split: r.loss for r in loss.eval_loss_robust(df).collect()}
    assert got["a"] == 2.0 and math.isinf(got["b"])


def test_tags_reversed_and_summary_null(spark):
    df = spark.createDataFrame([Row(generated="</think> <think>"), Row(generated="<think>x</think><answer>y</answer>")])
    f = evaluate.tag_flags(evaluate.tag_positions(df, "generated")).collect()
    assert not f[0].has_thinking and f[1].has_thinking and f[1].has_answer
    res = spark.createDataFrame([Row(has_thinking=True, has_answer=False, generation_time=0.0, reward_score=1.0), Row(has_thinking=False, has_answer=False, generation_time=0.0, reward_score=None)], "has_thinking boolean, has_answer boolean, generation_time double, reward_score double")
    s = evaluate.evaluation_summary(res).first()
    assert s.avg_reward is None and s.thinking_rate == 0.5


def test_blank_filter(spark):
    df = spark.createDataFrame([Row(t=" \t\n"), Row(t=""), Row(t=None), Row(t=" a "), Row(t=" "), Row(t="\u001c\u001f")], "t string")
    assert [r.t for r in clean.drop_blank_text(df, "t").collect()] == [" a "]


def test_weights_empty_corpus(spark):
    df = spark.createDataFrame([], "text string")
    w = stats.token_weights(stats.token_frequencies(stats.byte_histogram(df, "text"))).collect()
    assert len(w) == 256
    assert all(r.freq == pytest.approx(1 / 256) and r.weight == pytest.approx(1.0) for r in w)


def test_placeholder(spark):
    df = spark.createDataFrame([], "k long, text string")
    rows = clean.placeholder_if_empty(df, "text").collect()
    assert len(rows) == 1 and rows[0].text == "This is a placeholder text." and rows[0].k is None
    df2 = spark.createDataFrame([Row(k=1, text="x")])
    assert clean.placeholder_if_empty(df2, "text").count() == 1
