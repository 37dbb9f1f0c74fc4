import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bytelake.llm import packing
from bytelake.llm.packing import MAX_LEN, Tokens, default_tokenizer, pack, piece_lengths

OWN = Tokens(default_tokenizer())
FILE = Tokenizer.from_file(default_tokenizer())
FILE.encode_special_tokens = True


def file_ids(text):
    return FILE.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sda\x1c  ")), max_size=60))
def test_ids_equal_those_of_the_file(text):
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == file_ids(text)


def test_ids_of_real_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(200).collect()
    for (text,) in [*rows, ("a <|endoftext|> b  \n\n c",)]:
        assert np.frombuffer(OWN.encode(text), "<u4").tolist() == file_ids(text)


def test_piece_lengths():
    for n in [*range(1, 3000), 123_457]:
        got = piece_lengths(n)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= MAX_LEN for x in got)
        assert got == sorted(got, reverse=True) and len(got) == n // 1024 + bin(n % 1024).count("1")


def test_round_trip(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "wörd  x\n" * 9000), (1, "a b c"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    got = pack(df).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    assert all(r.length == len(r.ids) == 1 << r.bucket for r in got)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for doc, text in [(2, ""), (3, ""), (4, rows[3][1]), (None, "z")]:
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        ids = [i for r in own for i in r.ids]
        assert ids == file_ids(text) + [0] and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
    assert sum(r.doc_id == 1 for r in got) == 2 * len(piece_lengths(len(file_ids("a b c")) + 1))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_added_tokens_as_in_the_file_as_loaded(spark):
    end = "<|endoftext|>"
    texts = [f"a {end} b", f"x{end}{end}y", f"a  {end}  \n b", end, f" {end}", "<|endoftext|", f"<{end}>", f"a  {end}\n\n", "<|ENDOFTEXT|>", "a  b "]
    want = {i: LOADED.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 0]
    got = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, ids in want.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}


LOADED = Tokenizer.from_file(default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "  ", "\n", "a", "'s", "é", "1"]), max_size=12).map("".join))
def test_ids_around_added_tokens(text):
    assert np.frombuffer(OWN.encode_as_loaded(text), "<u4").tolist() == LOADED.encode(text, add_special_tokens=False).ids


def test_buckets_are_whole_ranges_of_ids_that_do_not_depend_on_partitions(spark, monkeypatch):
    rows = [(i, "word " * (i * 7 % 90)) for i in range(300)] + [(None, "same text again")] * 90 + [(5, "x y z")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [tuple(r) for r in pack(df.repartition(2), with_ids=False).orderBy("sequence_id").collect()]
    for crowded in (packing.CROWDED, 30):  # with 30, the repeated pieces are spread
        monkeypatch.setattr(packing, "CROWDED", crowded)
        got = [[tuple(r) for r in pack(df.repartition(n), with_ids=False).orderBy("sequence_id").collect()] for n in (1, 7)]
        assert got[0] == got[1] and (got[0] == plain or crowded == 30)
        assert sorted(map(str, (r[:5] for r in got[0]))) == sorted(map(str, (r[:5] for r in plain)))
        assert [r[5] for r in got[0]] == list(range(len(plain)))
        buckets = [r[7] for r in got[0]]
        assert buckets == sorted(buckets) and all(r[2] == 1 << r[7] for r in got[0])
