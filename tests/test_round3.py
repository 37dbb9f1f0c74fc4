"""Selection, aligned lists, dense lookup."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.functions.rng import u01
from bytelake.functions.selection import order_statistics
from bytelake.operators import aligned as al
from bytelake.operators import rewards as rw
from bytelake.operators import split


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_order_statistics_match_a_sort(spark):
    df = spark.range(5000).withColumn("u", u01(3, "id"))
    ordered = [(r.u, r.id) for r in df.orderBy("u", "id").collect()]
    found = order_statistics(df, F.col("u"), "id", lambda n: [F.lit(0), n - 1, F.lit(1234), n]).first().cuts
    assert [tuple(x) if x else None for x in found] == [ordered[0], ordered[-1], ordered[1234], None]


def test_order_statistics_of_ties(spark):
    df = spark.range(300).select("id", (F.col("id") % 3 / 8).alias("u"))
    found = order_statistics(df, F.col("u"), "id", lambda n: [F.lit(5), F.lit(150)]).first().cuts
    assert [(x.u, x.key) for x in found] == [(0.0, 15), (0.125, 151)]


def test_splits_of_a_million_rows_are_exact_and_move_no_row(spark):
    df = spark.range(1_000_003).withColumn("payload", F.repeat(F.lit("x"), 20))
    three = split.split_three_way(df, "id", 0.2, 0.5)
    sizes = {r.split: r["count"] for r in three.groupBy("split").count().collect()}
    hold = math.ceil(0.2 * 1_000_003)
    test = math.ceil(0.5 * hold)
    assert sizes == {"train": 1_000_003 - hold, "val": hold - test, "test": test}
    assert not any("payload" in line for line in exchanges(three))
    two = split.split_two_way(df, "id", 0.1)
    assert {r.split: r["count"] for r in two.groupBy("split").count().collect()} == {"train": 1_000_003 - 100_001, "val": 100_001}


@pytest.mark.parametrize("n, want", [(0, {}), (1, {"test": 1}), (2, {"train": 1, "test": 1}), (3, {"train": 2, "test": 1})])
def test_small_splits(spark, n, want):
    got = split.split_three_way(spark.range(n), "id", 0.2, 0.5).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == want


def candidates(spark):
    rnd = random.Random(2)
    rows = []
    for k in range(40):
        ref = bytes(rnd.randrange(256) for _ in range(rnd.randrange(0, 30)))
        gen = bytearray(ref[: rnd.randrange(0, 40)])
        for i in range(len(gen)):
            if rnd.random() < 0.3:
                gen[i] = rnd.randrange(256)
        rows.append((k, "model", bytes(gen) + bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 0, 5]))), ref))
    return spark.createDataFrame(rows + [(90, "model", b"", b"abc"), (91, "model", b"", b""), (92, "model", b"x", b"")],
                                 "pair_id long, cand string, g binary, r binary")


def model_of(spark):
    rnd = random.Random(5)
    return spark.createDataFrame([(f"{c:02X}", n, rnd.random()) for c in range(0, 256, 2) for n in range(256)], "ctx string, next int, prob double")


KEYS = ["pair_id", "cand"]


def close(a, b):
    assert sorted(a) == sorted(b)
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-9), k


def test_lists_agree_with_the_long_forms(spark):
    df, model = candidates(spark).cache(), model_of(spark).cache()
    x = al.aligned_lists(df, "g", "r", al.dense_model(model)).withColumn("rule", al.with_end_penalty(F.lit(2.0))).cache()
    rule = rw.token_rewards(df, KEYS, "g", "r", F.lit(2.0)).cache()
    long = {(r.pair_id, r.pos): r.reward for r in rule.collect()}
    close({(r.pair_id, i): v for r in x.collect() for i, v in enumerate(r.rule)}, long)
    lp = rw.token_logprobs(df.where("g IS NOT NULL"), KEYS, "g", model).cache()
    close({(r.pair_id, i): v for r in x.collect() for i, v in enumerate(r.logps)}, {(r.pair_id, r.pos): r.logp for r in lp.collect()})
    sc = rw.token_matches(df, KEYS, "g", "r").select(*KEYS, "pos", F.when(F.col("match"), 1.0).otherwise(-0.5).alias("reward")).cache()
    seq = sc.groupBy(*KEYS).agg(F.avg("reward").alias("score"))
    h = rw.hybrid_reward(rule, sc, seq, KEYS, 0.7)
    got = x.select("pair_id", al.hybrid_list("rule", "scores", 0.7).alias("h"))
    close({(r.pair_id, i): v for r in got.collect() for i, v in enumerate(r.h)}, {(r.pair_id, r.pos): r.reward for r in h.collect()})
    kl = lp.select(*KEYS, "pos", (F.col("logp") + math.log(256.0)).alias("kl"))
    want = {r.pair_id: r for r in rw.policy_loss(lp, rule, KEYS, kl, 4).collect()}
    for r in al.policy_loss_lists(x, "rule", "logps", -math.log(256.0), 4).collect():
        w = want.get(r.pair_id)
        for c in ("policy_loss", "kl_loss", "scaled_loss", "avg_reward"):
            assert r[c] == pytest.approx(w[c] if w else 0.0, abs=1e-9), (r.pair_id, c)
        assert r.n_tokens == (w.n_tokens if w else 0)
    tseq = rule.groupBy(*KEYS).agg(F.sum("reward").alias("score")).withColumn("b", F.lit(1))
    want = rw.reward_fit_error(sc, rule, seq, tseq, KEYS, "b").first()
    got = al.fit_errors(x, "rule", "scores").agg(*[F.avg(c).alias(c) for c in ("token_mse", "seq_se", "loss")], F.count("*").alias("n")).first()
    assert got.n == want.n and [got[c] for c in ("token_mse", "seq_se", "loss")] == pytest.approx([want[c] for c in ("token_mse", "seq_se", "loss")])


def test_null_bytes_count_as_empty(spark):
    df = spark.createDataFrame([(None, b"ab"), (b"ab", None)], "g binary, r binary")
    got = al.aligned_lists(df, "g", "r").withColumn("rule", al.with_end_penalty(F.lit(1.0))).collect()
    assert [r.rule for r in got] == [[-0.5], []] and [r.gen_len for r in got] == [0, 2]


def test_lists_move_nothing_by_position(spark):
    df = candidates(spark)
    vector = np.zeros(257 * 256)
    x = al.aligned_lists(df, "g", "r", vector).withColumn("rule", al.with_end_penalty(F.lit(1.0)))
    assert not exchanges(al.policy_loss_lists(x, "rule", "logps", 0.0)) and not exchanges(al.episode_sums(x))


def test_dense_lookup(spark):
    model = model_of(spark)
    vector = al.dense_model(model)
    chosen = model.where("next % 50 = 3").select("ctx", "next")
    want = {(r.ctx, r.next): math.log(r.prob) for r in model.collect()}
    for r in al.token_logprob(chosen, vector).collect():
        assert r.logp == pytest.approx(want[r.ctx, r.next])
    assert vector[256 * 256 + 7] == pytest.approx(-math.log(256)) and vector[3 * 256 + 1] == pytest.approx(-math.log(256))
    with pytest.raises(ValueError):
        al.dense_model(spark.createDataFrame([("4141", 1, 0.5)], "ctx string, next int, prob double"))


def test_doc_perplexity(spark):
    model = model_of(spark)
    table = {(int(r.ctx, 16), r.next): r.prob for r in model.collect()}
    texts = ["", "a", "ab", "a\0b", None, "longer text é" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in al.doc_perplexity(df, "doc_id", "text", al.dense_model(model)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        nll = [-math.log(table.get((x, y), 1 / 256)) for x, y in zip(b, b[1:]) if y]
        if not nll:
            assert i not in got
        else:
            assert got[i].n_tokens == len(nll) and got[i].perplexity == pytest.approx(math.exp(sum(nll) / (len(nll) + 1e-9)))


def test_large_samples_are_cut_by_selection(spark):
    df = spark.range(3000).withColumn("payload", F.repeat(F.lit("y"), 9))
    small, large = (split.sample_fixed_n(df, "id", 700, 5, one_task=t) for t in (1000, 100))
    assert not any("payload" in line for line in exchanges(large))
    assert sorted(r.id for r in small.collect()) == sorted(r.id for r in large.collect())
    assert split.sample_fixed_n(df, "id", 5000, 5, one_task=10).count() == 3000


def test_appended_history_is_written_once(spark, tmp_path):
    from bytelake.sources import sinks

    path = str(tmp_path / "history")
    rows = spark.range(1, 61).select(F.col("id").alias("episode"), (F.col("id") * 2).alias("v"))
    for part in (rows.where("episode <= 30"), rows.where("episode > 30"), rows.where("episode > 30"), rows.where("episode = 35").withColumn("v", F.lit(7).cast("long"))):
        sinks.append_history(part, path)
    got = {r.episode: (r.v, r.snapshot) for r in spark.read.parquet(path).collect()}
    assert got == {e: (7 if e == 35 else 2 * e, -(-e // 20)) for e in range(1, 61)}


def test_datasets_are_published_whole_and_once(spark, tmp_path):
    from bytelake.sources import sinks

    path, data = f"{tmp_path}/set", f"{tmp_path}/in"
    assert sinks.publish(spark.range(5), path) and not sinks.publish(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["set"]
    spark.range(3).write.parquet(data)
    mark = sinks.manifest(spark, [data], 1)
    assert mark == sinks.manifest(spark, [data], 1) != sinks.manifest(spark, [data], 2)
    spark.range(1).write.mode("append").parquet(data)
    assert mark != sinks.manifest(spark, [data], 1)
