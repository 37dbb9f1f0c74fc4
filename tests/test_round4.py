"""Faults found in round 3: streams over folders of part files, memory of the byte counts."""

import os
import tempfile
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from __spark_entry__ import queries
from bytelake.functions import arrow_counts
from bytelake.operators import ngram, stats
from bytelake.streaming import streams as st

from .conftest import SF_SMALL


def _as_folders(spark, *names):
    """The tables as folders of three part files each."""
    d = tempfile.mkdtemp(prefix="bytelake-folders-")
    for name in names:
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").repartition(3).write.parquet(os.path.join(d, f"{name}.parquet"))
    return d


@pytest.mark.parametrize(
    ("name", "source"),
    [("stream_byte_histogram", "documents"), ("stream_score_rewards", "conversations"), ("stream_metric_windows", "events"), ("stream_best_so_far", "events")],
)
def test_streams_read_folders_of_part_files(spark, name, source):
    d = _as_folders(spark, source)
    got = sorted(map(str, queries()[name](spark, d).collect()))
    want = sorted(map(str, queries()[name](spark, SF_SMALL).collect()))
    assert got == want and len(got) > 0


def test_histogram_of_a_table_without_rows(spark):
    d = tempfile.mkdtemp(prefix="bytelake-empty-")
    os.makedirs(os.path.join(d, "documents.parquet"))
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    s = st.read_table_stream(spark, os.path.join(d, "documents.parquet"), schema)  # a folder without files: no micro-batch at all
    rows = st.full_histogram(spark, st.run_complete(st.stream_byte_histogram(s, "text"), "t_empty")).collect()
    assert len(rows) == 256 and sum(r.cnt for r in rows) == 0


def test_byte_and_ngram_counts_hold_one_block(spark):
    """A batch of 10,000 rows (24 MB of text) is counted in blocks: before, the 64-bit arrays of a whole batch took over 40 times its bytes."""
    rng = np.random.default_rng(4)
    rows = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in rng.integers(0, 4800, 10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(np.arange(len(rows)) % 7)], names=["text", "g"])
    for task, grouped in ((ngram._count_task(1, False), False), (ngram._count_task(1, True), True), (stats._hist_task, None)):
        tracemalloc.start()
        total = 0
        for out in task(iter([batch])):
            total += sum(out.column(out.num_columns - 1).to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total == sum(len(r) if grouped is None else max(0, len(r) - 1) for r in rows)
        assert peak < 40_000_000


@pytest.mark.parametrize("k", [1, 2, 3])
def test_ngram_blocks_against_a_plain_count(monkeypatch, k):
    """Values longer and shorter than a block, empty ones, and blocks that begin inside a context."""
    monkeypatch.setattr(arrow_counts, "BLOCK", 5)
    values = [b"abcabcabcabcab", b"", b"a", b"bc", None, b"cab", b"aaaaaaaaaaa", b"", b"b"]
    want = Counter((i, int.from_bytes(v[p - k : p + 1], "big")) for i, v in enumerate(values) if v for p in range(k, len(v)))
    got = Counter()
    for codes, owner in arrow_counts.ngram_blocks(*arrow_counts.value_bytes(pa.array(values, pa.binary())), k, with_owner=True):
        got.update(zip(owner.tolist(), codes.tolist(), strict=True))
    assert got == want
