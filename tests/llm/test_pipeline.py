import zlib
from itertools import combinations

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from bytelake.llm.bm25_decontamination import question_and_answer, words
from bytelake.llm.crf_language import LEAST_SCORE, identify_language
from bytelake.llm.golay_simhash import fingerprint
from bytelake.llm.packing import default_tokenizer, piece_lengths

SF = "/root/testdata/sf0.001"


def survivors(spark):
    """The pipeline's decisions, stage by stage, in plain Python."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    score = {r.doc_id: r.score for r in identify_language(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    docs = {i: t for i, t in docs.items() if score[i] >= LEAST_SCORE}
    docs = {i: t for t, i in {t: i for i, t in sorted(docs.items())}.items()}
    fp = {i: fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        if bin(fp[a] ^ fp[b]).count("1") <= 2 and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    docs = {i: t for i, t in docs.items() if find(i) == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaked(text):
        own = words(text)
        grams = {n: {tuple(own[k : k + n]) for k in range(len(own))} for n in range(1, 6)}
        return any(
            all(sum(tuple(p[k : k + 5]) in grams[min(5, len(p))] for k in range(max(1, len(p) - 4))) >= 0.8 * max(1, len(p) - 4) for p in question_and_answer(t))
            for t in items
        )

    return {i: t for i, t in docs.items() if not leaked(t)}


def test_pipeline_matches_plain_python(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    want = survivors(spark)
    assert {r.doc_id for r in got} == set(want) and 0 < len(want) < 200
    tok = Tokenizer.from_file(default_tokenizer())
    for i, text in want.items():
        ids = tok.encode(text, add_special_tokens=False).ids + [0]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.length for r in own] == piece_lengths(len(ids)) and [x for r in own for x in r.ids] == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)


def test_stages_keep_columns_and_take_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
