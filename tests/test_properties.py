"""Properties on the fixture tables: exact splits, partition independence, block/stream identities,
normalisation, closed forms, and the corrupted variant against a brute-force Python twin."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from bytelake.functions.binary import utf8
from bytelake.functions.rank import with_exclusive_sum, with_row_index
from bytelake.operators import blocks, evaluate, ngram, nucleus, rewards, split, stats, tokens
from bytelake.plans import splits as ps
from bytelake.plans.registry import table

from .conftest import SF_SMALL


def docs(spark):
    return table(spark, SF_SMALL, "documents").select("doc_id", "text")


def test_split_exact_disjoint_complete(spark):
    d = docs(spark)
    n = d.count()
    s = split.split_three_way(d, "doc_id", 0.2, 0.5, 42)
    sizes = {r.split: r.n_rows for r in split.split_sizes(s).collect()}
    hold = math.ceil(0.2 * n)
    test = math.ceil(0.5 * hold)
    assert sizes == {"train": n - hold, "val": hold - test, "test": test}
    assert s.select("doc_id").distinct().count() == n


def test_partition_independence(spark):
    d = docs(spark)
    a = {(r.doc_id, r.split) for r in split.split_three_way(d, "doc_id").collect()}
    b = {(r.doc_id, r.split) for r in split.split_three_way(d.repartition(7), "doc_id").collect()}
    assert a == b
    h1 = {r.byte: r.cnt for r in stats.byte_histogram(d).collect()}
    h2 = {r.byte: r.cnt for r in stats.byte_histogram(d.repartition(5)).collect()}
    assert h1 == h2


def test_row_index_with_quantile_buckets(spark):
    d = docs(spark)
    r = with_row_index(d.repartition(3), ["doc_id"], buckets=7).collect()
    got = sorted((x.doc_id, x.idx) for x in r)
    assert [i for _, i in got] == list(range(len(got)))
    s = with_exclusive_sum(d, ["doc_id"], F.octet_length("text"), "off", buckets=5).collect()
    run, expect = 0, {}
    for x in sorted(d.collect(), key=lambda x: x.doc_id):
        expect[x.doc_id] = run
        run += len(x.text.encode())
    assert {x.doc_id: x.off for x in s} == expect


def _stream_bytes(spark):
    return b"".join(r.text.encode() for r in sorted(docs(spark).collect(), key=lambda r: r.doc_id))


def test_packed_blocks_equal_stream(spark):
    offs = blocks.stream_offsets(docs(spark), "doc_id", "text")
    blk = sorted(blocks.stream_blocks_packed(docs(spark), offs, "doc_id", "text", 256).collect(), key=lambda r: r.block_id)
    stream = _stream_bytes(spark)
    assert len(blk) == (len(stream) - 1) // 256
    assert b"".join(bytes(r.x) for r in blk) == stream[: 256 * len(blk)]
    for r in blk:
        assert bytes(r.y)[:-1] == bytes(r.x)[1:]
        assert bytes(r.y) == stream[r.start_off + 1 : r.start_off + 257]


def test_random_blocks_are_slices(spark):
    offs = blocks.stream_offsets(docs(spark), "doc_id", "text")
    stream = _stream_bytes(spark)
    for r in blocks.stream_blocks_random(docs(spark), offs, "doc_id", "text", 128, 40, 7).collect():
        assert 0 <= r.start_off < len(stream) - 128
        assert bytes(r.x) == stream[r.start_off : r.start_off + 128]
        assert bytes(r.y) == stream[r.start_off + 1 : r.start_off + 129]


def test_weights_mean_one_and_softmax(spark):
    w = stats.token_weights(stats.token_frequencies(stats.byte_histogram(docs(spark)))).collect()
    assert sum(r.weight for r in w) / 256 == pytest.approx(1.0)
    m = ngram.ngram_probs(ngram.ngram_counts(docs(spark), "text", 1), 1.0)
    sums = m.groupBy("ctx").agg(F.sum("prob").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    sm = ngram.softmax_rows(m.withColumn("logit", F.log("prob") * 3.0), "ctx", "logit")
    assert all(r.s == pytest.approx(1.0) for r in sm.groupBy("ctx").agg(F.sum("prob").alias("s")).collect())


def test_top_p_keeps_mass(spark):
    m = ngram.ngram_probs(ngram.ngram_counts(docs(spark), "text", 1), 1.0).withColumn("w", F.col("cnt") + 1)
    k = nucleus.top_p_filter(m, "ctx", "next", "w", 0.8)
    agg = k.groupBy("ctx").agg(F.sum("share").alias("kept"), F.count(F.lit(1)).alias("n"), F.sum("prob").alias("p")).collect()
    assert all(r.n >= 1 and r.p == pytest.approx(1.0) and r.kept >= 0.8 - 1e-12 for r in agg)


def test_closed_form_total_equals_array(spark):
    p = ps.pairs(spark, SF_SMALL).withColumn("g", utf8(F.substring("response", 1, 40))).withColumn("r", utf8("response"))
    p = p.withColumn("s", F.lit(2.0))
    arr = {r.pair_id: sum(r.rw) for r in rewards.with_reward_array(p, "g", "r", F.col("s"), "rw").collect()}
    tot = {r.pair_id: r.total_reward for r in rewards.total_reward(rewards.match_features(p, "g", "r"), "s").collect()}
    assert arr.keys() == tot.keys()
    assert all(arr[k] == pytest.approx(tot[k]) for k in arr)


def _py_u01(seed, *keys):
    h = hashlib.md5(":".join([str(seed)] + [str(k) for k in keys]).encode()).hexdigest()
    return int(h[:13], 16) / 2**52


def test_corrupted_variant_brute_force(spark):
    p = ps.pairs(spark, SF_SMALL)
    got = {(r.pair_id, r.cand): r.completion for r in rewards.synthetic_variants(p, "pair_id", "response", 42).collect()}
    for r in p.collect():
        b = bytearray(r.response.encode())
        n = len(b)
        for j in range(min(n // 10, 20)):
            b[int(_py_u01(42, "idx", r.pair_id, j) * n)] = int(_py_u01(42, "val", r.pair_id, j) * 256)
        assert got[(r.pair_id, "corrupt")] == bytes(b).decode("utf-8", errors="replace")
        rb = r.response.encode()
        for name, f in (("p75", 0.75), ("p50", 0.5), ("p25", 0.25)):
            assert got[(r.pair_id, name)] == rb[: int(len(rb) * f)].decode("utf-8", errors="replace")


def test_decode_replace_matches_python(spark):
    rnd = random.Random(3)
    blobs = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(0, 40))) for _ in range(300)]
    blobs += [b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"a\xe1\x80b"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, bytes binary")
    got = {r.i: r.text for r in tokens.decode_replace(df, "bytes").collect()}
    assert all(got[i] == b.decode("utf-8", errors="replace") for i, b in enumerate(blobs))


def test_running_min_by_group_matches_python(spark):
    from bytelake.functions.rank import with_running_min_by_group

    rnd = random.Random(11)
    rows = [(g, s, rnd.random()) for g in ("a", "b") for s in range(400)]
    df = spark.createDataFrame(rows, "run string, step int, v double").repartition(5)
    got = {(r.run, r.step): r.prev for r in with_running_min_by_group(df, ["run"], ["step"], "v", "prev", buckets=8).collect()}
    for g in ("a", "b"):
        m = None
        for s in range(400):
            assert got[(g, s)] == m
            v = next(x[2] for x in rows if x[0] == g and x[1] == s)
            m = v if m is None else min(m, v)


@pytest.mark.parametrize("p", [0.3, 0.8])
def test_top_p_hot_group_brute_force(spark, p):
    """One group holds most rows, with near-equal and exactly equal weights at the cut."""
    rnd = random.Random(5)
    rows = [("hot", i, 1_000_000 + rnd.randrange(50)) for i in range(3000)]
    rows += [("hot", 5000 + i, 999_990) for i in range(300)]
    rows += [("cold", i, rnd.randrange(1, 100)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long, w long").repartition(6)
    got = {(r.g, r.i): r.prob for r in nucleus.top_p_filter(df, "g", "i", "w", p).collect()}
    want = {}
    for g in ("hot", "cold"):
        items = sorted([(w, i) for gg, i, w in rows if gg == g], key=lambda t: (-t[0], t[1]))
        tot, prec, kept = sum(w for w, _ in items), 0, []
        for w, i in items:
            if prec <= p * tot:
                kept.append((w, i))
            prec += w
        km = sum(w for w, _ in kept)
        want.update({(g, i): w / km for w, i in kept})
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_cut_lineage_writes_once_and_keeps_rows(spark):
    from bytelake.session import cut_lineage

    d = docs(spark).groupBy(F.length("text") % 7).count()
    c = cut_lineage(d)
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, d.collect()))
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # read back from the shared folder, lineage cut


def test_sections_and_corrupted_copies_are_whole(spark):
    text = "<think>" + "t" * 500 + "</think><answer>" + "a" * 700 + "</answer> end"
    tagged = evaluate.tag_flags(evaluate.tag_positions(spark.createDataFrame([(text,)], "generated string")))
    r = evaluate.tag_spans(tagged).collect()[0]
    assert r.think_span == "<think>" + "t" * 500 + "</think>" and r.answer_span == "<answer>" + "a" * 700 + "</answer>"
    rows = [(i, "xyzä" * n) for i, n in enumerate((0, 1, 2, 3, 50, 3000))]
    df = spark.createDataFrame(rows, "pair_id int, reference string").selectExpr("cast(pair_id as string) pair_id", "reference", "reference completion", "false includes_prompt")
    got = {r.pair_id: r.completion for r in rewards.candidates_in_row(df).filter("cand = 'corrupt'").collect()}
    for i, ref in rows:
        b = bytearray(ref.encode())
        n = len(b)
        for j in range(n // 10):
            b[int(_py_u01(42, "idx", str(i), j) * n)] = int(_py_u01(42, "val", str(i), j) * 256)
        assert got[str(i)] == bytes(b).decode("utf-8", errors="replace")
