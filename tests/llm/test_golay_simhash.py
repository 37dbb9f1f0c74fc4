import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bytelake.llm.golay_simhash import fingerprint, golay_indices, golay_keys, golay_tables, keep_one_per_component, links, simhash_components


def brute_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "A b c", "É a b c d É a b", "x y z w\x1cq r", "w1 w2 w3 " * 7000])
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def test_golay_code_is_perfect():
    rem, errors = golay_tables()
    assert len(set(errors.tolist())) == 2048 and max(bin(e).count("1") for e in errors.tolist()) == 3


def test_words_within_two_bits_share_an_index():
    rnd = random.Random(3)
    for _ in range(300):
        x = rnd.getrandbits(23)
        y = x ^ (1 << rnd.randrange(23)) ^ (1 << rnd.randrange(23))
        a, b = golay_indices(np.array([x, y], np.int64))
        assert set(a.tolist()) & set(b.tolist())
        assert len(set(a.tolist())) <= 6 + 1


def roots(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("crowded", [2, 64])
def test_links_lose_nothing(spark, crowded):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(15)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rnd.sample(range(64), rnd.randrange(1, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted({signed(x) for x in fps})
    keys, owners = golay_keys(fps)
    assert len(keys) <= 18 * len(fps) + 3 * len(fps)
    from bytelake.llm.components import components

    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components(links(df, crowded)).collect()}
    want = roots(fps)
    assert {f: got.get(f, f) for f in fps} == want


def documents(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for g in range(12):
        body = [rnd.choice(words) for _ in range(300)]
        for k in range(rnd.randrange(1, 6)):
            own = list(body)
            if k:
                own[rnd.randrange(300)] = "edit"
            rows.append((100 - i, " ".join(own)))
            i += 1
    rows += [(1001, None), (1002, ""), (1003, " \n"), (1004, "one"), (1005, "ONE"), (1005, "ONE"), (None, "one"), (1006, "v " * 60_000)]
    return rows + [(100, 'other text under a used id'), (None, 'only a null id')]


def test_components_match_brute_force(spark):
    rows = documents(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(3)
    got = simhash_components(df).collect()
    assert len(got) == len(rows)
    fp = {signed(fingerprint(t or "")) for _, t in rows}
    root = roots(fp)
    least = {}
    for i, t in rows:
        r = root[signed(fingerprint(t or ""))]
        least[r] = min([x for x in (i, least.get(r)) if x is not None], default=None)
    for r in got:
        assert r.component_id == least[root[r.fp]]
    kept = keep_one_per_component(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, root[signed(fingerprint(r.text or ""))]) for r in kept.collect()]
    assert sorted(left, key=str) == sorted(((i, r) for r, i in least.items()), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(df).count() == 0 and keep_one_per_component(df).count() == 0
