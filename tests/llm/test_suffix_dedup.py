import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.llm import suffix_dedup
from bytelake.llm.suffix_dedup import gram_hashes, remove_repeats, sample_names


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    at = defaultdict(list)
    for d, x in enumerate(data):
        for p in range(len(x) - length + 1):
            at[x[p : p + length]].append((d, p))
    gone = [bytearray(len(x)) for x in data]
    for places in at.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + length] = b"\x01" * length
    out = []
    for x, g in zip(data, gone):
        runs = sum(g[k] and (k == 0 or not g[k - 1]) for k in range(len(g)))
        out.append((len(x), sum(g), runs, bytes(c for c, r in zip(x, g) if not r)))
    return out


def corpus(seed, alphabet, n, scale):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(scale // 2, scale * 4))) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            p = rnd.choice(passages)
            b = rnd.randrange(len(p))
            parts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(scale * 2))), p if rnd.random() < 0.4 else p[b : b + rnd.randrange(scale * 3)]]
        texts.append("".join(parts))
    return texts + [None, "", "aaaa" * scale, "ab" * scale, "ab" * scale * 2, texts[0], texts[1][: scale * 2], "é" * scale * 2]


def check(spark, texts, length, sample, **options):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("_key", F.lit(1)).repartition(3)
    got = {r.doc_id: r for r in remove_repeats(df, length=length, sample=sample, **options).collect()}
    for i, want in enumerate(brute(texts, length)):
        r = got[i]
        assert (r.n_bytes, r.n_bytes - len(r.kept), len(r.begins), bytes(r.kept)) == want, i


@pytest.mark.parametrize("seed, alphabet, length, sample, bits", [(1, "abcdefgh é", 40, 30, 18), (2, "ab", 24, 16, 10), (3, "xyzuvw ", 60, 25, 4)])
def test_matches_brute_force(spark, seed, alphabet, length, sample, bits):
    check(spark, corpus(seed, alphabet, 30, length), length, sample, bits=bits)


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    texts = corpus(4, "abcd ", 12, 40)
    names = [sample_names((t or "").encode(), 40, 30) for t in texts]
    assert sum(map(len, names)) > len(texts)
    data = np.frombuffer(b"abcabcabc", np.uint8)
    h = gram_hashes(data, 3)
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 3


def test_production_length(spark):
    rnd = random.Random(9)
    line = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    passage = line(900)
    texts = [line(500) + passage + line(300), passage[:399] + line(100), passage[100:500], line(3000), passage + line(10) + passage, line(50)] + [line(2000)] * 3
    check(spark, texts, 400, 300, bits=20)


def test_repeated_rows_and_ids(spark):
    text = "".join(random.Random(1).choice("abc") for _ in range(600))
    df = spark.createDataFrame([(1, text), (1, text), (None, text[:450]), (1, "short"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, len(r.kept)) for r in remove_repeats(df, bits=12).collect())
    assert got == Counter({(1, 600, 0): 2, (None, 450, 0): 1, (1, 5, 5): 1, (None, 0, 0): 1})


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string"), bits=12).count() == 0
