import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from bytelake.llm.crf_language import CHAIN, LEAST_SCORE, Labeler, fit, forward_backward, identify_language, keep_identified, to_word

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3))
    valid = np.array([[True] * 5, [True, True, True, False, False]])
    post, pairs = forward_backward(scores, valid, moves, pairs=True)
    want_pairs = np.zeros((3, 3))
    for c, n in ((0, 5), (1, 3)):
        want, total, own = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(scores[c, k, y] for k, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += p
            for k, y in enumerate(path):
                want[k, y] += p
            for a, b in zip(path, path[1:]):
                own[a, b] += p
        assert np.allclose(post[c, :n], want / total)
        want_pairs += own / total
    assert np.allclose(pairs, want_pairs)


def labelled(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_held_out_accuracy(spark):
    rows = labelled(spark)
    got = {r.doc_id: r for r in identify_language(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    out = [(got[i].lang_pred == lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(rows) and len(out) > 100
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert sum(out) / len(out) > 0.95 and all(0 <= r.score <= 1 for r in got.values())


def test_predictions_ignore_label_source_and_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("clash"))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in identify_language(d).collect()} for d in (docs, other))
    assert a == b


def test_code_switched_text_is_labelled_word_by_word(spark):
    rows = [(t, lang) for i, t, lang in labelled(spark) if i % 2]
    labeler = Labeler(fit(rows, sequences=600, steps=30))
    texts = {lang: next(t for i, t, x in labelled(spark) if i % 2 == 0 and x == lang and len(t) > 600) for lang in ("en", "de")}
    a, b = texts["en"].split()[:30], texts["de"].split()[:30]
    got = labeler.label_words(" ".join(a + b))
    first = [x for _, x in got[:25]]
    last = [x for _, x in got[-25:]]
    assert first.count("en") > 20 and last.count("de") > 20


def test_words():
    assert [to_word(t) for t in ("Thon.", "|", "42", "l'été,", "(x)", "", "_a_")] == ["thon", "", "", "l'été", "x", "", "a"]


def test_signs_that_are_no_letters_are_no_words(spark):
    assert [to_word(x) for x in ["½", "²", "Ⅷ", "_", "x²", "½a", "ª"]] == ["", "", "", "", "x²", "½a", "ª"]
    rows = [(i, "the cat sat on the mat", "en") for i in range(30)] + [(i, "le chat est sur la table", "fr") for i in range(30, 60)]
    df = spark.createDataFrame([*rows, (100, "½ ² Ⅷ", "fr"), (101, "½ 12 . _", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(df).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[0][0] == "en"
    assert {r.doc_id for r in keep_identified(df).collect()} == set(range(60))


def test_odd_rows(spark):
    train = [(100 + k, t, lang) for k, (i, t, lang) in enumerate(labelled(spark)) if k < 200]
    odd = [(1, None, "en"), (2, "", "en"), (3, "12 | 34", None), (4, "the of and " * 60_000, None), (5, "the of and", None), (5, "the of and", None), (None, "the and of", None)]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).repartition(3)
    got = identify_language(df).collect()
    assert len(got) == len(train) + len(odd)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 3} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got if r.doc_id in (4, 5)} == {"en"}
    kept = keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {4, 5, None} and kept.filter("doc_id in (1, 2, 3)").count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify_language(df).collect()] == [("und", 0.0)]
    assert identify_language(df.limit(0)).count() == 0
    assert CHAIN > 1


def test_mixed_and_unlabelled_texts_stay(spark):
    by_lang = {}
    for _, t, lang in labelled(spark):
        by_lang.setdefault(lang, []).append(t)
    assert len(by_lang) == 4
    train = [(100 + 4 * k + j, t, lang) for j, (lang, ts) in enumerate(sorted(by_lang.items())) for k, t in enumerate(ts[:60])]
    mixed = " ".join(w for ws in zip(*(max(ts, key=len).split()[:120] for ts in by_lang.values())) for w in ws)
    quarters = " ".join(w for ts in by_lang.values() for w in max(ts, key=len).split()[:120])
    rows = [*train, (1, mixed, None), (2, quarters, None), (3, "12 | 34", None), (4, None, "en"), (5, "qqxz", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    score = {r.doc_id: r.score for r in identify_language(df).collect()}
    assert score[2] < LEAST_SCORE
    kept = {r.doc_id: r for r in keep_identified(df).collect()}
    assert set(kept) == {i for i, *_ in rows} - {3, 4}
    assert kept[1].lang in by_lang and kept[2].lang in by_lang and kept[5].lang == "zz"


def test_pipeline_stage_without_any_label(spark):
    rows = [(1, "a b", None), (2, "1 2", None), (3, None, None), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.language_id(spark, df, SF).collect()] == [(1, "a b", None)]
