"""Streaming operators.  Each takes a streaming DataFrame and returns a streaming DataFrame; the
``run_*`` helpers drain a source with ``trigger(availableNow=True)`` into a parquet folder under
the shared checkpoint directory and read the result back as a batch DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VOCAB, RewardConfig
from ..functions.binary import utf8
from ..operators.rewards import match_features, total_reward
from ..operators.stats import _hist_task
from ..session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    return f"{shared_dir(spark)}/bytelake-streams/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, schema, file_glob: str = "*.parquet", files_per_trigger: int | None = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of ``folder`` matching ``file_glob`` as a stream, ``files_per_trigger`` or about ``bytes_per_trigger`` per
    micro-batch (both None: all that are there)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    elif files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, path: str, schema, bytes_per_trigger: int | None = 256 << 20) -> DataFrame:
    """The table at ``path`` as a stream, be it one parquet file or a folder of part files; only Spark's file systems are asked."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    folder, glob = at.getParent(), at.getName()
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        folder, glob = at, "*"
    return read_stream(spark, folder.toString(), schema, glob, None, bytes_per_trigger)


def stream_byte_histogram(stream: DataFrame, col: str = "text") -> DataFrame:
    """Running byte counts: each micro-batch is counted per task (256 rows), state holds 256 keys."""
    part = stream.select(F.col(col)).mapInArrow(_hist_task, "byte int, cnt long")
    return part.groupBy("byte").agg(F.sum("cnt").alias("cnt"))


def score_stream(stream: DataFrame, scale: float = 1.0, cfg: RewardConfig = RewardConfig()) -> DataFrame:
    """Match features and totals of rows carrying ``completion`` and ``reference`` (stateless)."""
    j = stream.withColumn("__g", utf8("completion")).withColumn("__r", utf8("reference"))
    f = match_features(j, "__g", "__r").drop("__g", "__r").withColumn("scale", F.lit(float(scale)))
    return total_reward(f, "scale", cfg)


def stream_score_rewards(stream: DataFrame, refs: DataFrame, keys: list[str], scale: float = 1.0, complete=None, cfg: RewardConfig = RewardConfig()) -> DataFrame:
    """Score arriving rows against a static reference table (stream-static join, stateless); ``complete`` turns the joined
    rows into ones with ``completion`` and ``reference`` where the stream doesn't carry them."""
    joined = stream.join(refs, keys)
    return score_stream(complete(joined) if complete else joined, scale, cfg)


def ntz_as_utc(col: str):
    """timestamp_ntz wall time read as a UTC instant, independent of the session time zone."""
    c = F.col(col)
    secs = F.date_part(F.lit("SECOND"), c)  # seconds with fraction
    return F.make_timestamp_ltz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), secs, F.lit("UTC"))


def stream_metric_windows(stream: DataFrame, ts: str, value: str, group: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tumbling-window count and mean with a watermark; append mode emits a window once closed and
    drops rows that arrive after their window was closed."""
    s = stream.withColumn("__t", ntz_as_utc(ts) if dict(stream.dtypes)[ts] == "timestamp_ntz" else F.col(ts))
    s = s.withWatermark("__t", delay)
    agg = s.groupBy(F.window("__t", size).alias("w"), F.col(group)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value")
    )
    return agg.select(
        F.unix_seconds(F.col("w.start")).alias("window_start"), F.unix_seconds(F.col("w.end")).alias("window_end"), group, "n", "avg_value"
    )


def stream_best_so_far(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running minimum per key (order-free, so micro-batch order does not matter)."""
    return stream.groupBy(key).agg(F.min(value).alias("best"), F.count(F.lit(1)).alias("n"))


def run_complete(df: DataFrame, name: str) -> DataFrame:
    """Drain with availableNow in complete mode; each batch overwrites the output with the full state (empty without any batch)."""
    spark = df.sparkSession
    base = scratch(spark, name)
    out = f"{base}/out"
    spark.createDataFrame([], df.schema).write.parquet(out)

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (
        df.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", f"{base}/ckpt")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_append(df: DataFrame, name: str) -> DataFrame:
    """Drain with availableNow in append mode into a parquet file sink."""
    spark = df.sparkSession
    base = scratch(spark, name)
    out = f"{base}/out"
    q = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{base}/ckpt")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def full_histogram(spark: SparkSession, counts: DataFrame) -> DataFrame:
    ids = spark.range(VOCAB).select(F.col("id").cast("int").alias("byte"))
    return ids.join(F.broadcast(counts), "byte", "left").select("byte", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
