"""Streaming queries over the fixture files, each drained with an availableNow trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.formatting import pair_key
from ..streaming import streams as st
from .corpus import SQL_HIST
from .fixtures import SQL_COMPLETIONS, completions
from .registry import ensure_scratch, query, table
from .rewards import sql_totals
from .splits import pairs


def _stream(spark, sf, name, **options):
    ensure_scratch(spark)
    return st.read_table_stream(spark, f"{sf.rstrip('/')}/{name}.parquet", table(spark, sf, name).schema, **options)


@query("stream_byte_histogram", sql=SQL_HIST)
def q_stream_byte_histogram(spark, sf):
    s = _stream(spark, sf, "documents")
    counts = st.run_complete(st.stream_byte_histogram(s.where(F.col("text").isNotNull()), "text"), "byte_histogram")
    return st.full_histogram(spark, counts)


@query(
    "stream_score_rewards",
    sql=f"""WITH c AS ({SQL_COMPLETIONS}),
f AS (SELECT pair_id, octet_length(encode(completion)) AS gen_len, octet_length(encode(reference)) AS ref_len,
        list_zip(regexp_extract_all(hex(encode(completion)), '..'), regexp_extract_all(hex(encode(reference)), '..')) AS z FROM c),
sc AS (SELECT pair_id, gen_len, ref_len, CAST(len(list_filter(z, lambda q: q[1] = q[2])) AS BIGINT) AS matches,
        CAST(coalesce(list_sum(list_transform(z, lambda q, i: CASE WHEN q[1] = q[2] THEN i - 1 ELSE 0 END)), 0) AS BIGINT) AS match_pos_sum FROM f),
t AS ({sql_totals('1.0')} FROM sc)
SELECT pair_id, matches, match_pos_sum, round(base + penalty, 9) AS total_reward FROM t""",
)
def q_stream_score_rewards(spark, sf):
    """User turns arrive as a stream; a stream-static join attaches the reply to each (the reference), the
    fixture completion is formed and scored against it (scale 1.0)."""
    users = _stream(spark, sf, "conversations").where(F.col("role") == "user").select(pair_key().alias("pair_id"), F.col("text").alias("prompt"))
    refs = pairs(spark, sf).select("pair_id", "response")
    sc = st.stream_score_rewards(users, refs, ["pair_id"], 1.0, lambda j: completions(spark, sf, j))
    out = st.run_append(sc.select("pair_id", "matches", "match_pos_sum", "total_reward"), "score_rewards")
    return out.select("pair_id", "matches", "match_pos_sum", F.round("total_reward", 9).alias("total_reward"))


@query(
    "stream_metric_windows",
    sql="""WITH w AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, event_type, value, ts FROM events),
wm AS (SELECT CAST(epoch(max(ts)) AS BIGINT) - 3600 AS wm FROM events)
SELECT window_start, window_start + 86400 AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS avg_value
FROM w, wm GROUP BY window_start, event_type, wm.wm HAVING window_start + 86400 <= wm.wm""",
)
def q_stream_metric_windows(spark, sf):
    """1-day tumbling windows per event type with a 1-hour watermark; only closed windows are emitted.  The part files of a table are
    in no order of time, so one micro-batch takes them all: file by file, the later ones' rows would come late and go."""
    s = _stream(spark, sf, "events", bytes_per_trigger=None)
    out = st.run_append(st.stream_metric_windows(s, "ts", "value", "event_type", "1 day", "1 hour"), "metric_windows")
    return out.select("window_start", "window_end", "event_type", "n", F.round("avg_value", 6).alias("avg_value"))


@query("stream_best_so_far", sql="SELECT event_type, min(value) AS best, count(*) AS n FROM events GROUP BY event_type")
def q_stream_best_so_far(spark, sf):
    s = _stream(spark, sf, "events")
    return st.run_complete(st.stream_best_so_far(s, "event_type", "value"), "best_so_far")
