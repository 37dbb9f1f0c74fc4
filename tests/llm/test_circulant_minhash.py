import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.llm import circulant_minhash
from bytelake.llm.circulant_minhash import band_keys, minhash_components, prefix, second_permutation, shingle_set, signature
from bytelake.llm.common import map_rows


def grams(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def brute(rows, percent=85):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min([x for x in (i, least.get(r)) if x is not None], default=None)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[find(k)] if sets[k] else i
        out.append((i, len(sets[k]), c, i is not None and i == c))
    return sorted(out, key=str)


def corpus(seed=1, groups=14, size=8, boiler=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    fixed = [rnd.choice(vocabulary) for _ in range(boiler)]
    rows = []
    for _ in range(groups):
        body = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 40, 150, 400]))]
        for _ in range(rnd.randrange(1, size)):
            own = list(body)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(fixed + own)))
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "oNE"), (5, "oNE"), (None, "one"), (None, "alone with null"), (None, None), (6, "É a b c d e"), (7, "é a b c d e")]
    return rows + odd + [(8, "x y\x1cz " * 9000), (1000, "another text of a used id")]


def got(spark, texts, **options):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "key", "n", "_id", "_h", "kept")})
    return sorted((tuple(r) for r in minhash_components(df.repartition(3), **options).collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_chains_in_crowded_bands(spark):
    """Texts that share a long passage fill bands; chains of small edits link only neighbours, stragglers link to nothing."""
    rnd = random.Random(3)
    body = [f"w{rnd.randrange(5000)}" for _ in range(160)]
    rows = []
    for k in range(60):
        if k % 3 == 0:
            body = list(body)
            body[(k * 7) % 160] = f"edit{k}"
        own = body[:-20] + [f"s{k}-{j}" for j in range(40)] if k % 5 == 4 else body
        rows.append((k, " ".join(own)))
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) > 5
    assert got(spark, rows, crowded=3, hubs=2) == want


def test_other_limits(spark):
    texts = corpus(5, 8, 5, boiler=30)
    assert got(spark, texts, percent=60, bands=48, rows=4, crowded=4, hubs=1) == brute(texts, 60)


def test_second_permutation_is_a_bijection_under_shifts():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537) + np.uint32(11)
    assert len(np.unique(second_permutation(x))) == len(x)
    one = shingle_set("a b c d e f g")
    place = (one >> np.uint64(32)).astype(np.uint32)
    sig = signature(one, 5)
    assert [int(second_permutation(place - np.uint32(k)).min()) for k in range(5)] == sig.tolist()


def test_agreement_estimates_similarity():
    rnd = random.Random(8)
    a = np.unique(np.array([rnd.getrandbits(64) for _ in range(1000)], np.uint64))
    b = np.concatenate((a[:900], np.array([rnd.getrandbits(64) for _ in range(100)], np.uint64)))
    same = (signature(a, 512) == signature(b, 512)).mean()
    assert abs(same - 900 / 1100) < 0.08
    assert len(band_keys(a)) == 32


def test_similar_sets_share_a_prefix():
    rnd = random.Random(6)
    counts = np.array([rnd.choice([2, 3, 9]) for _ in range(1 << 22)], np.uint8)
    for _ in range(300):
        n = rnd.randrange(1, 60)
        a = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate((a[rnd.randrange(3) :], np.array([rnd.getrandbits(64) for _ in range(rnd.randrange(8))], np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            (ka, ia), (kb, ib) = prefix(a, counts, 85), prefix(b, counts, 85)
            need = -(-85 * (len(a) + len(b)) // 185)
            places = dict(zip(kb.tolist(), ib.tolist(), strict=True))
            assert any(k in places and min(len(a) - i, len(b) - places[k]) >= need for k, i in zip(ka.tolist(), ia.tolist(), strict=True))


@pytest.mark.parametrize("text, n", [("", 0), (" \x0b", 0), ("a", 1), ("a b c d", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a a a", 1)])
def test_set_sizes(text, n):
    assert len(shingle_set(text)) == n


def test_empty_table(spark):
    assert got(spark, []) == []


def test_sets_are_shuffled_only_to_meet_their_partners(spark, monkeypatch):
    """Lists of pairs and open nodes go to the sets, whatever Spark would broadcast by itself."""
    plans = {}
    keep = circulant_minhash.stored

    def spied(df, tag):
        plans.setdefault(tag, df._jdf.queryExecution().sparkPlan().toString())
        return keep(df, tag)

    read = []

    def spied_rows(df, *a):
        if df.columns == ["node", "grams"] or df.columns == ["grams"]:
            read.append(df._jdf.queryExecution().sparkPlan().toString())
        return map_rows(df, *a)

    monkeypatch.setattr(circulant_minhash, "stored", spied)
    monkeypatch.setattr(circulant_minhash, "map_rows", spied_rows)
    rows = corpus(2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in (plans["links"], *read):
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert len(read) == 2


@pytest.mark.parametrize("size", [1000, 1 << 20, 1 << 22])
def test_count_table_grows_with_the_shingles(spark, size):
    """A full table makes all shingles look frequent, and pairs to be verified grow faster than the input."""
    rnd = np.random.default_rng(size)
    sets = [np.unique(rnd.integers(0, 1 << 63, size // 4, np.uint64)) for _ in range(4)]
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, grams binary")
    total = sum(map(len, sets))
    counts = circulant_minhash._count_table(frame, total)
    assert len(counts) >= max(2 * total, 1 << 22) and int(counts.sum()) == total
    want = np.bincount((np.concatenate(sets) % np.uint64(len(counts))).astype(np.int64), minlength=len(counts))
    assert (counts == want).all()


def test_rows_with_one_id_and_text(spark):
    rnd = random.Random(12)
    body = [f"w{rnd.randrange(900)}" for _ in range(80)]
    near = [*body[:40], "edit", *body[41:]]
    rows = [(None, " ".join(body))] * 3 + [(5, " ".join(near))] * 2 + [(4, " ".join(near)), (9, " ".join([*near[:60], "other"])), (7, " ".join(body))]
    assert got(spark, rows) == brute(rows)
