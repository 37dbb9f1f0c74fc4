"""Streaming twins fed in three micro-batches equal their batch twins."""

import os
import tempfile

from pyspark.sql import functions as F

from bytelake.operators import formatting, stats
from bytelake.streaming import streams as st

from .conftest import SF_SMALL


def _three_files(spark, name, key):
    d = tempfile.mkdtemp(prefix="bytelake-stream-src-")
    df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
    for i in range(3):
        df.where(F.col(key) % 3 == i).coalesce(1).write.parquet(os.path.join(d, f"part{i}"))
    files = []
    for i in range(3):
        sub = os.path.join(d, f"part{i}")
        for f in os.listdir(sub):
            if f.endswith(".parquet"):
                os.link(os.path.join(sub, f), os.path.join(d, f"{name}-{i}.parquet"))
    return d, df.schema


def test_histogram_three_batches(spark):
    d, schema = _three_files(spark, "documents", "doc_id")
    s = st.read_stream(spark, d, schema, "documents-*.parquet", files_per_trigger=1)
    got = {r.byte: r.cnt for r in st.full_histogram(spark, st.run_complete(st.stream_byte_histogram(s, "text"), "t_hist")).collect()}
    want = {r.byte: r.cnt for r in stats.byte_histogram(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), "text").collect()}
    assert got == want


def test_best_so_far_three_batches(spark):
    d, schema = _three_files(spark, "events", "event_id")
    s = st.read_stream(spark, d, schema, "events-*.parquet", files_per_trigger=1)
    got = {(r.event_type, r.best, r.n) for r in st.run_complete(st.stream_best_so_far(s, "event_type", "value"), "t_best").collect()}
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    want = {(r.event_type, r.best, r.n) for r in ev.groupBy("event_type").agg(F.min("value").alias("best"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_scores_three_batches(spark):
    d, schema = _three_files(spark, "conversations", "conv_id")
    s = st.read_stream(spark, d, schema, "conversations-*.parquet", files_per_trigger=1)
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    pairs = formatting.pair_turns(conv)
    users = s.where("role = 'user'").select(formatting.pair_key().alias("pair_id"), F.col("text").alias("completion"))
    refs = pairs.select("pair_id", F.col("response").alias("reference"))
    got = st.run_append(st.stream_score_rewards(users, refs, ["pair_id"]).select("pair_id", "matches", "total_reward"), "t_score")
    batch = pairs.select("pair_id", F.col("prompt").alias("completion"), F.col("response").alias("reference"))
    want = st.score_stream(batch).select("pair_id", "matches", "total_reward")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_windows_close_and_late_rows_go(spark):
    """Four files: day 1; day 3; day 5 (day 1 is closed by now); a late row of day 1, which goes, and one of day 7."""
    d = tempfile.mkdtemp(prefix="bytelake-stream-late-")
    days = [[("2024-01-01 10:00:00", 1.0), ("2024-01-01 11:00:00", 3.0)], [("2024-01-03 10:00:00", 5.0)], [("2024-01-05 09:00:00", 7.0)], [("2024-01-01 12:00:00", 100.0), ("2024-01-07 09:00:00", 9.0)]]
    schema = "ts timestamp, value double, kind string"
    for i, rows in enumerate(days):
        out = os.path.join(d, f"b{i}")
        df = spark.createDataFrame([(t, v, "k") for t, v in rows], "ts string, value double, kind string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(out)
        name = next(f for f in os.listdir(out) if f.endswith(".parquet"))
        os.link(os.path.join(out, name), os.path.join(d, f"late-{i}.parquet"))
        os.utime(os.path.join(d, f"late-{i}.parquet"), (1_700_000_000 + 60 * i,) * 2)  # files are taken by age
    s = st.read_stream(spark, d, spark.createDataFrame([], schema).schema, "late-*.parquet", files_per_trigger=1)
    got = st.run_append(st.stream_metric_windows(s, "ts", "value", "kind", "1 day", "1 hour"), "t_late")
    rows = sorted((r.window_start, r.n, r.avg_value) for r in got.collect())
    assert rows == [(1704067200, 2, 2.0), (1704240000, 1, 5.0), (1704412800, 1, 7.0)]
