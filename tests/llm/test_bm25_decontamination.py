import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bytelake.llm.bm25_decontamination import B, K1, THRESHOLD, ItemIndex, blocks_to_score, contamination, drop_contaminated, find_leaks, question_and_answer, score_block, words

RND = random.Random(11)
COMMON = "the of and to in a is that it was for".split()
RARE = [f"w{i}" for i in range(600)]


def sentence(n):
    return " ".join(RND.choice(COMMON if RND.random() < 0.4 else RARE) for _ in range(n)).capitalize() + "."


ITEMS = [(i, sentence(RND.randrange(5, 14)) + " " + sentence(RND.randrange(4, 9))) for i in range(60)] + [(60, "The a."), (61, None), (62, ""), (63, "one.")]


def brute_scores(window, items):
    """Full BM25 share of every item for a set of window words."""
    seqs = {i: words(t) for i, t in items if t and words(t)}
    df = Counter(w for s in seqs.values() for w in set(s))
    n, mean = len(seqs), sum(map(len, seqs.values())) / len(seqs)
    out = {}
    for i, s in seqs.items():
        own = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(s) / mean)) for w, c in Counter(s).items()}
        out[i] = sum(x for w, x in own.items() if w in window) / sum(own.values())
    return out


def test_bounds_lose_no_pair():
    index = ItemIndex(ITEMS)
    for _ in range(150):
        window = words(sentence(25)) + words(ITEMS[RND.randrange(60)][1])[: RND.randrange(1, 20)]
        terms = np.unique([index.term[w] for w in window if w in index.term])
        above = terms[~index.common[terms]]
        blocks = blocks_to_score(index, np.zeros(len(above), int), above, THRESHOLD)
        got = {index.ids[i] for _, b in blocks for i in score_block(index, terms, b, THRESHOLD)}
        want = {i for i, s in brute_scores(set(window), ITEMS).items() if s >= THRESHOLD - 1e-9}
        assert got == want


def brute_leaks(text, index, items):
    seq, half = words(text or ""), index.longest
    out = set()
    for at in range(0, max(1, len(seq)), half):
        own = seq[at : at + 2 * half]
        scores = brute_scores(set(own), items)
        for i, t in items:
            if t and words(t) and scores[i] >= THRESHOLD - 1e-9:
                ok = []
                for part in (*question_and_answer(t), words(t)):
                    n = min(5, len(part))
                    grams = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
                    ok.append(sum(any(tuple(own[j : j + n]) == g for j in range(len(own) - n + 1)) for g in grams) >= 0.8 * len(grams))
                if ok[0] and ok[1] or ok[2]:
                    out.add(i)
    return sorted(out)


def texts():
    out = [None, "", " ... ", "The a.", "one", "one two"]
    for k in range(30):
        body = [sentence(RND.randrange(3, 60)) for _ in range(RND.randrange(1, 6))]
        if k % 3:
            item = words(ITEMS[RND.randrange(60)][1])
            if k % 3 == 2:
                item[RND.randrange(len(item))] = "changed"
            body.insert(RND.randrange(len(body) + 1), " ".join(item).upper() + "!")
        out.append("\n".join(body))
    return out + ["w1 " * 60_000 + ITEMS[7][1]]


def test_leaks_match_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, ITEMS[3][1]), (3, "The a."), (3, "The a.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash")).repartition(3)
    bench = spark.createDataFrame(ITEMS + ITEMS[:5], "item_id long, text string").withColumn("doc_id", F.lit(1))
    index = ItemIndex(ITEMS)
    want = Counter((i, str(brute_leaks(t, index, ITEMS)) if t is None or len(t) < 50_000 else "[7]") for i, t in rows)
    got = contamination(df, bench).collect()
    assert Counter((r.doc_id, str(r["items"])) for r in got) == want
    assert sum("[]" != k[1] for k in want) > 8
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in rows if (i, "[]") in want)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(docs.limit(0), bench).count() == 0
    assert [r["items"] for r in contamination(docs, bench.limit(0)).collect()] == [[]]
    assert find_leaks(ItemIndex([]), ["a b"]) == [[]]


def test_a_changed_word_in_a_short_answer_clears_nothing():
    question = " ".join(f"q{i}" for i in range(40))
    index = ItemIndex([(1, f"{question}. a1 a2 a3 a4 a5."), (2, "other words here. none of them.")])
    near = f"x y {question} a1 a2 a3 a4 changed z"
    assert find_leaks(index, [near, " ".join(f"q{i}" for i in range(25)) + " a1 a2 a3 a4 a5"]) == [[1], []]


def test_more_items_than_one_index_holds_and_items_without_id(spark):
    rows = [(i, f"start {t} end") for i, t in ITEMS[:60]] + [(90, "nothing of it"), (91, None), (None, ITEMS[5][1])]
    rows += [(92, " ".join(t for _, t in ITEMS[10:13]) + " the item without id has words of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [*ITEMS[:60], (None, "The item without id has words of its own."), (None, "Another item that has no id either.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["items"] for r in contamination(docs, bench, max_items=7).collect()}
    assert all(i in got[i] for i in range(60)) and got[90] == got[91] == [] and 5 in got[None]
    assert got[92] == [10, 11, 12, None]
    kept = drop_contaminated(docs, bench, max_items=7)
    assert sorted(r.doc_id for r in kept.collect()) == [90, 91] and kept.columns == docs.columns
