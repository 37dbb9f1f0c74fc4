"""Alias tables and Bloom filters."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.functions.bloom import bloom_filter, may_contain
from bytelake.operators import alias, split


@pytest.mark.parametrize("weights", [[1.0], [1, 1, 1], [5, 1e-9, 3, 0.5], list(range(1, 200)), [1e300, 1e-300]])
def test_an_alias_table_holds_its_distribution(weights):
    keep, other = alias.alias_table(np.array(weights, float))
    got = keep.copy()
    np.add.at(got, other, 1 - keep)
    assert got / len(weights) == pytest.approx(np.array(weights) / sum(weights), abs=1e-12)


def weighted(spark):
    rnd = random.Random(4)
    rows = [("hot", i, rnd.random()) for i in range(700)] + [("b", 1, 3.0), ("b", 2, 1.0), ("b", 2, 2.0), (None, 7, 1.0), (None, None, 3.0)]
    rows += [("b", 3, 0.0), ("b", 4, None), ("none", 1, 0.0), ("b", 5, float("nan")), ("b", 6, -1.0)]
    return spark.createDataFrame(rows, "g string, i long, w double")


def masses(rows):
    total, own = Counter(), Counter()
    for g, i, w in rows:
        if w is not None and w > 0:
            total[g] += w
            own[g, i] += w
    return {k: v / total[k[0]] for k, v in own.items()}


def test_tables_in_chunks_hold_the_distribution(spark):
    df = weighted(spark)
    tables = alias.build(df, "g", "i", "w", chunk=64)
    assert tables.where("g = 'hot'").count() == 11
    got = {(r.g, r.i): r.prob for r in alias.implied_masses(tables, "g", "i").collect()}
    want = masses(df.collect())
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_draws_follow_the_distribution_by_chi_square(spark):
    df = spark.createDataFrame([(g, i, float(i % 7 + 1)) for g in ("a", "b") for i in range(40)], "g string, i long, w double")
    m = 20_000
    draws = alias.draw(alias.build(df, "g", "i", "w", chunk=8), "g", "i", m, 5)
    assert {tuple(r) for r in draws.groupBy("g").agg(F.countDistinct("draw"), F.max("draw")).collect()} == {("a", m, m - 1), ("b", m, m - 1)}
    want = masses(df.collect())
    seen = {(r.g, r.i): r["count"] for r in draws.groupBy("g", "i").count().collect()}
    for g in ("a", "b"):
        assert sum(n for (h, _), n in seen.items() if h == g) == m
        chi = sum((seen.get(k, 0) - m * p) ** 2 / (m * p) for k, p in want.items() if k[0] == g)
        assert chi < 80  # 39 degrees of freedom: beyond 80 in one of 8,000 cases


def test_draws_do_not_depend_on_partitioning_and_know_nulls(spark):
    df = weighted(spark)
    one = alias.draw(alias.build(df.repartition(1), "g", "i", "w", chunk=64), "g", "i", 1500)
    many = alias.draw(alias.build(df.repartition(7), "g", "i", "w", chunk=64), "g", "i", 1500)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    got = Counter((r.g, r.i) for r in one.collect())
    assert {g for g, _ in got} == {"hot", "b", None} and {i for g, i in got if g == "b"} == {1, 2}
    assert got[None, None] + got[None, 7] == 1500 and got[None, None] > 1000
    assert one.select("g", "draw").distinct().count() == 4500


def test_no_draws(spark):
    df = weighted(spark)
    assert alias.draw(alias.build(df, "g", "i", "w"), "g", "i", 0).count() == 0
    assert alias.draw(alias.build(df.limit(0), "g", "i", "w"), "g", "i", 9).count() == 0


def test_a_bloom_filter_loses_none_and_prunes(spark):
    small = spark.range(0, 2000).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    large = spark.range(1000, 41_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("d"))
    kept = may_contain(large, F.col("d"), bloom_filter(small, F.col("d"), 17), 17)
    ids = {r.id for r in kept.select("id").collect()}
    assert kept.columns == ["id", "d"] and set(range(1000, 2000)) <= ids
    assert len(ids) < 1000 + 200  # (4000 / 131072)^2 of 39,000: about 36


def test_leaks_equal_a_plain_comparison(spark):
    rnd = random.Random(1)
    a = [(rnd.randrange(400), rnd.choice(["x", "y", None, f"t{rnd.randrange(300)}"])) for _ in range(500)] + [(None, "n")]
    b = [(rnd.randrange(800), f"t{rnd.randrange(600)}") for _ in range(200)] + [(None, "n"), (3, None)]
    frames = [spark.createDataFrame(x, "k long, t string") for x in (a, b)]
    keys, texts = {k for k, _ in a if k is not None}, {t for _, t in a if t is not None}
    got = split.split_leak_check(*frames, "k", "t").first().asDict()
    assert got == {
        "n_a": 501, "n_b": 202, "key_overlap": sum(k in keys for k, _ in b), "text_overlap": sum(t in texts for _, t in b),
        "key_only_b": sum(k not in keys for k, _ in b),
    }
