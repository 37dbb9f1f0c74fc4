"""Behaviour that the DuckDB twins can't see: keys, gaps, independence, types, stop rule, workers."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from bytelake.functions.rank import with_exclusive_sum, with_row_index, with_running_agg_by_group
from bytelake.functions.rng import u01
from bytelake.operators import blocks, evaluate, formatting, loss, ngram, nucleus, rewards, split, stats, tokens
from bytelake.sources import sinks

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_pairs_keep_gaps_and_large_turns_apart(spark):
    rows = [(1, 65536, "user", "a"), (1, 65540, "assistant", "A"), (2, 0, "user", "b"), (2, 2, "assistant", "B"), (2, 3, "user", "c"), (2, 4, "user", "d"), (2, 9000, "assistant", "D"), (3, 1, "assistant", "x")]
    got = formatting.pair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [("1:65536", "a", "A"), ("2:0", "b", "B"), ("2:4", "d", "D")]


def test_draws_of_operators_are_independent(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), F.lit("x").alias("text"))
    s = split.split_hash(df, "k", (0.5, 0.5), ("a", "b"))
    aug = formatting.augment_prompt_mix(s, "k", "text", 0.5, out="t2").withColumn("aug", F.col("t2") != F.col("text"))
    both = {(r.split, r.aug): r["count"] for r in aug.groupBy("split", "aug").count().collect()}
    assert len(both) == 4 and all(abs(n - 1500) < 150 for n in both.values())
    crop = blocks.window_crop_or_pad(split.split_three_way(df.withColumn("r", F.expr("cast(concat(repeat('a', 100), repeat('b', 100)) as binary)")), "k"), "k", "r", 20)
    first = {r.split: r.a for r in crop.groupBy("split").agg(F.avg((F.substring("x", 1, 1) == F.unhex(F.lit("61"))).cast("int")).alias("a")).collect()}
    assert all(abs(a - 100 / 180) < 0.08 for a in first.values())


def test_string_keys(spark):
    keys = [f"doc-{i}" for i in range(2000)] + ["", "é"]
    df = spark.createDataFrame([(k, len(k)) for k in keys], "k string, n int").repartition(5)
    want = {k: i for i, k in enumerate(sorted(keys, key=lambda x: x.encode()))}
    assert {r.k: r.idx for r in with_row_index(df, ["k"]).collect()} == want
    offs, total = {r.k: r.off for r in with_exclusive_sum(df, ["k"], F.col("n").cast("long"), "off").collect()}, 0
    for k in sorted(keys, key=lambda x: x.encode()):
        assert offs[k] == total
        total += len(k)
    run = with_running_agg_by_group(df.withColumn("g", F.length("k") % 2), ["g"], ["k"], "n", "before", "sum").collect()
    for g in (0, 1):
        total = None
        for r in sorted((r for r in run if r.g == g), key=lambda r: r.k.encode()):
            assert r.before == total
            total = (total or 0) + r.n
    drawn = nucleus.sample_categorical(df.withColumn("g", F.lit(1)).withColumn("p", F.lit(1.0)), "g", "k", "p").collect()
    assert len(drawn) == 1 and drawn[0].k in want
    assert split.draw_with_replacement(df, "k", 500).count() == 500
    d = df.withColumn("text", F.col("k"))
    offs = blocks.stream_offsets(d, "k", "text")
    stream = b"".join(k.encode() for k in sorted(keys, key=lambda x: x.encode()))
    for r in blocks.stream_blocks_packed(d, offs, "k", "text", 64).collect():
        assert bytes(r.x) == stream[r.start_off : r.start_off + 64] and bytes(r.y) == stream[r.start_off + 1 : r.start_off + 65]


def test_offsets_shuffle_no_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = blocks.stream_offsets(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffles
    x = blocks.stream_blocks_random(df, blocks.stream_offsets(df, "doc_id", "text"), "doc_id", "text", 128, 3)
    window = x._jdf.queryExecution().optimizedPlan().toString().split("Window")[1:]
    assert all("text" not in w.split("\n")[0] and "bytes#" not in w.split("\n")[0].replace("n_bytes#", "") for w in window)


def test_tied_weights_at_the_cut(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").alias("i"), F.when(F.col("id") < 10, 1000).otherwise(1).cast("long").alias("w"))
    got = nucleus.top_p_filter(df, "g", "i", "w", 0.5).select("i").collect()
    total = 10 * 1000 + 19_990
    kept, before = [], 0
    for i in range(20_000):
        if before <= 0.5 * total:
            kept.append(i)
        before += 1000 if i < 10 else 1
    assert sorted(r.i for r in got) == kept


def test_stop_reasons(spark):
    ans, think = b"</answer>", b"</think>"
    cases = [
        (b"ctx", b"ab\xffcd", 100, ("eos", 3)),
        (b"ctx", think + b"x" + ans + b"tail", 100, ("answer_end", 18)),
        (b"has " + think, b"y" + ans + b"tail", 100, ("answer_end", 10)),
        (b"ctx", b"y" + ans + b"tail", 100, ("complete", 14)),
        (b"ctx", b"y" * 50, 10, ("max_length", 20)),
        (b"ctx", b"abc", 100, ("complete", 3)),
        (think, b"</ans\x00\x00wer>z", 100, ("answer_end", 11)),
        (think, b"</ans" + b"\x00" * 40 + b"wer>z", 100, ("complete", 50)),
        (b"ctx", ans + b"q" * 40 + think + b"more", 100, ("complete", 61)),
        (b"ctx", ans + b"q" * 5 + think + b"more", 100, ("answer_end", 22)),
        (b"", b"", 0, ("max_length", 0)),
        (think + ans, b"zz", 100, ("answer_end", 1)),
    ]
    df = spark.createDataFrame([(i, bytearray(c), bytearray(g), n) for i, (c, g, n, _) in enumerate(cases)], "i int, c binary, g binary, n int")
    got = {r.i: (r.stop_reason, r.stop_len) for r in tokens.stop_reason(df, "g", "n", "c").collect()}
    assert got == {i: w for i, (*_, w) in enumerate(cases)}


def brute_stop(context, gen, limit):
    for p in range(1, min(len(gen), limit) + 1):
        if gen[p - 1] == 255:
            return "eos", p
        whole = context + gen[:p]
        recent = bytes(b for b in whole[-30:] if b)
        if b"</answer>" in recent and b"</think>" in bytes(b for b in whole if b):
            return "answer_end", p
    return ("max_length", limit) if len(gen) >= limit else ("complete", len(gen))


def test_stop_rule_against_stepwise_generation():
    import random

    rnd = random.Random(4)
    parts = [b"</answer>", b"</think>", b"</ans", b"wer>", b"\x00", b"\x00" * 12, b"text", b"q" * 25, b"\xff"]
    for _ in range(800):
        context = b"".join(rnd.choice(parts[:-1]) for _ in range(rnd.randrange(4)))
        gen = b"".join(rnd.choice(parts) for _ in range(rnd.randrange(9)))
        limit = rnd.randrange(1, 90)
        assert tokens._first_stop(context, gen, limit) == brute_stop(context, gen, limit), (context, gen, limit)


def test_kl_enters_the_scaled_loss(spark):
    lp = spark.createDataFrame([(1, 0, -1.0), (1, 1, -2.0)], "k int, pos int, logp double")
    rw = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0)], "k int, pos int, reward double")
    kl = spark.createDataFrame([(1, 0, 3.0), (1, 1, 1.0)], "k int, pos int, kl double")
    r = rewards.policy_loss(lp, rw, ["k"], kl, accumulation=4).first()
    assert r.policy_loss == 2.5 and r.kl_loss == pytest.approx(0.4) and r.scaled_loss == pytest.approx(2.9 / 4)
    assert rewards.policy_loss(lp, rw, ["k"]).first().scaled_loss == pytest.approx(2.5 / 4)


def test_mean_reward_needs_every_score(spark):
    rows = [(1, "<think>a</think><answer>b</answer>", 1.0, 0.5), (2, "x", 1.0, None)]
    df = evaluate.tag_flags(evaluate.tag_positions(spark.createDataFrame(rows, "pair_id int, generated string, generation_time double, reward_score double")))
    assert evaluate.evaluation_summary(df).first().avg_reward is None
    assert evaluate.evaluation_summary(df.where("pair_id = 1")).first().avg_reward == 0.5


def test_reward_lists(spark):
    df = spark.createDataFrame([(bytearray(b"abcd"), bytearray(b"abxdef"), 2.0), (bytearray(b""), bytearray(b"ab"), 1.0), (bytearray(b"abc"), bytearray(b"ab"), 1.0), (None, bytearray(b""), 1.0)], "g binary, r binary, s double")
    got = [r.rewards for r in rewards.with_reward_array(df, "g", "r", F.col("s")).collect()]
    pen = -0.5 * 2 * 2 / 6
    assert got[0] == pytest.approx([0.1, 0.1 + 0.9 / 4, 0.0, 0.1 + 0.9 * 3 / 4 + pen])
    assert got[1] == pytest.approx([-0.5]) and got[2] == pytest.approx([0.1, 0.1 + 0.9 / 3]) and got[3] == []


def test_robust_median_and_context_orders(spark):
    rows = [("a", float(x)) for x in (5, 1, 4, 2)] + [("a", float("inf")), ("b", float("inf")), ("c", 3.0)]
    got = {r.split: (r.loss, r.n_finite, r.n_batches) for r in loss.eval_loss_robust(spark.createDataFrame(rows, "split string, loss double")).collect()}
    assert got == {"a": (2.0, 4, 5), "b": (float("inf"), 0, 1), "c": (3.0, 1, 1)}
    df = spark.createDataFrame([("abcabc",), ("abd",)], "text string")
    got = {(r.ctx, r.next): r.cnt for r in ngram.ngram_counts(df, "text", 2).collect()}
    assert got == {("6162", 99): 2, ("6263", 97): 1, ("6361", 98): 1, ("6162", 100): 1}
    with pytest.raises(ValueError):
        ngram.ngram_counts(df, "text", 7)


def test_sampled_histogram_always_samples(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "k int, text string")
    got = {r.byte: r.cnt for r in stats.byte_histogram_sampled(df, "k", "text", 300).where("cnt > 0").collect()}
    assert sum(got.values()) == 300 and set(got) == {97, 98, 99}
    assert stats.byte_histogram_sampled(df.limit(0), "k", "text", 10).agg(F.sum("cnt")).first()[0] == 0


def test_reuse_depends_on_content(spark, tmp_path):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert sinks.fingerprint([a], 1) == sinks.fingerprint([a], 1) != sinks.fingerprint([b], 1) != sinks.fingerprint([b], 2)
    path = str(tmp_path / "d")
    a.write.parquet(path)
    os.remove(f"{path}/_SUCCESS")  # an interrupted build
    assert sinks.reuse_or_build(spark, path, lambda: b).first().x == 2
    assert sinks.reuse_or_build(spark, path, lambda: a).first().x == 2


def test_labels_change_draws(spark):
    r = spark.range(1).select(u01(1, F.lit("a"), "id").alias("a"), u01(1, F.lit("b"), "id").alias("b")).first()
    assert r.a != r.b


def test_workers_get_the_package(tmp_path):
    """A driver started elsewhere, with the package on its own path only."""
    code = f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        import __spark_entry__ as E
        assert len(E.entry(s).collect()) == 256
        assert len(E.queries()["best_so_far"](s, "/root/testdata/sf0.001").collect()) > 0
        print("DONE")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "DONE" in r.stdout, r.stderr[-2000:]
