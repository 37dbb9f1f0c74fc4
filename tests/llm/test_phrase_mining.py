import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelake.llm.phrase_mining import _combined, collocations, frequent_prefixes, tokens, word_id


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=30, top=2000):
    f = defaultdict(Counter)
    total = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for b in range(len(p) - m + 1):
                    covered[p[b : b + m]] = max(covered[p[b : b + m]], a)
        found = []
        for p, a in cand.items():
            if 100 * covered[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).collect())


def corpus():
    rnd = random.Random(4)
    words = ["of", "The", "é", "New", "york", "City", "a\x1cb", "x"]
    fixed = ["new York city Hall", "in spite of", "ha ha ha ha ha"]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rnd.randrange(1, 30)):
            parts.append(rnd.choice(fixed) if rnd.random() < 0.4 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))))
        glue = [" ", ", ", ".\n", "\t", ";", "\x0b", "  "]
        rows.append((rnd.choice(["en", "fr", None]), "".join(p + rnd.choice(glue) for p in parts)))
    return rows + [("en", None), (None, ""), ("en", " . , "), ("de", "only few words"), *[("en", "the same row " * 20)] * 3, ("fr", "long tail " * 40_000)]


@pytest.mark.parametrize("least, top, bits", [(30, 2000, 26), (5, 7, 3), (12, 40, 16)])
def test_matches_brute_force(spark, least, top, bits):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(7) for c in ("_lang", "w0", "w1", "word", "id", "f", "rank")})
    assert got(df.repartition(3), least=least, top=top, bits=bits) == brute(rows, least, top)


def test_quicksort_counts_prefixes():
    rnd = random.Random(9)
    strings = [(1, *(rnd.randrange(1, 4) for _ in range(4))) for _ in range(900)]
    strings += [(1, a, b, 0, 0) for _, a, b, _, _ in strings] + [(1, a, b, c, 0) for _, a, b, c, _ in strings[:100]]
    weight = np.array([rnd.randrange(1, 5) for _ in strings])
    want = Counter()
    for s, w in zip(strings, weight.tolist(), strict=True):
        if not s[3]:
            want[s] += w
        else:
            want[(*s[:4], 0)] += w
            if s[4]:
                want[s] += w
    found = frequent_prefixes([np.array(c) for c in zip(*strings, strict=True)], weight, 50)
    assert len(found) == len(set(found))
    assert {f[:5]: f[5] for f in found} == {s: w for s, w in want.items() if w >= 50}


def test_combined_rows():
    rnd = np.random.default_rng(1)
    columns = [rnd.integers(0, 1 << 40, 6)[rnd.integers(0, 6, 500)] for _ in range(4)]
    distinct, n = _combined(columns)
    assert Counter(zip(*(c.tolist() for c in columns), strict=True)) == dict(zip(zip(*(c.tolist() for c in distinct), strict=True), n.tolist(), strict=True))
    assert _combined([np.zeros(0, np.int64)] * 4)[1].size == 0


def test_tokens():
    assert tokens("A,b\tC\x0bÉ.x y".encode()) == [b"a", b".", b"b", b"c", b".", "É".encode(), b".", b"x", b"y"]
    assert word_id(b"a") != word_id(b"a", b".") and -(2**63) <= word_id(b"a") < 2**63


def test_words_that_share_an_id_get_another_salt(spark):
    from bytelake.llm.phrase_mining import _named, _salted_id

    words = spark.createDataFrame([("en", bytearray(b"a")), ("en", bytearray(b"b")), ("fr", bytearray(b"a"))], "_lang string, word binary")
    ids, salt = _named(words)
    assert salt == b"" and {r.id for r in ids.collect()} == {word_id(b"a"), word_id(b"b")}
    assert {r.id for r in words.select(_salted_id(b"..").alias("id")).collect()} == {word_id(b"a", b".."), word_id(b"b", b"..")}
    _, salt = _named(words, named=lambda salt: F.lit(5) if len(salt) < 2 else _salted_id(salt))
    assert salt == b".."


def test_empty_and_all_null(spark):
    schema = "lang string, text string"
    assert got(spark.createDataFrame([], schema)) == []
    assert got(spark.createDataFrame([(None, None)] * 3, schema)) == []
    assert got(spark.createDataFrame([(None, "a b")] * 30, schema)) == [("und", 1, "a b", 30, 30, 30, 60, 1000000)]
