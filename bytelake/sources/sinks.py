"""Sinks: appending to a metric history, publishing and reusing finished datasets."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _fs_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def append_history(df: DataFrame, path: str, every: int = 20, episode_col: str = "episode") -> None:
    """Append metric rows to the history at ``path``, partitioned by snapshot number ``ceil(episode / every)``.

    An episode is written once: rows of episodes that are there already replace them, so a call repeated after a failure changes nothing.  Only
    the snapshots that the new rows touch are rewritten (dynamic partition overwrite); the others stay as they are.
    """
    new = df.withColumn("snapshot", F.ceil(F.col(episode_col) / every).cast("int"))
    if _fs_exists(df.sparkSession, path):
        new = cut_lineage(new)
        old = df.sparkSession.read.schema(new.schema).parquet(path)
        kept = old.join(new.select("snapshot").distinct(), "snapshot", "left_semi").join(new.select(episode_col), episode_col, "left_anti")
        new = cut_lineage(new.unionByName(kept))  # written first: what is read here is replaced below
    new.write.partitionBy("snapshot").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def manifest(spark: SparkSession, paths: list[str], *parameters) -> str:
    """Digest of the inputs' files (path, length, time of change) and the parameters: no row is read."""
    parts = [repr(p) for p in parameters]
    for path in paths:
        fs, p = _fs(spark, path)
        files = fs.listFiles(p, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
        parts += sorted(found)
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]


def publish(df: DataFrame, path: str) -> bool:
    """Write ``df`` beside ``path`` and rename it into place: readers see the whole dataset or none.  Of several builders the first
    one to finish publishes; the others' copies are deleted (False)."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    if _fs_exists(spark, path) and not _fs_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        target.getFileSystem(conf).delete(target, True)  # never published: what an interrupted build of another kind left
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        # unlike FileSystem.rename, this one never moves into a folder that exists
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, none)
    except Exception:
        source.getFileSystem(conf).delete(source, True)
        if not _fs_exists(spark, path):
            raise
        return False
    return True


def reuse_or_build(spark: SparkSession, path: str, build_fn: Callable[[], DataFrame]) -> DataFrame:
    """Read the dataset published at ``path`` or build and publish it.  The path should hold :func:`manifest` of all inputs and parameters."""
    if not _fs_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        publish(build_fn(), path)
    return spark.read.parquet(path)


def fingerprint(inputs: list[DataFrame], *parameters) -> str:
    """Digest of the contents of the inputs (row count and sum of row hashes, one scan each) and the parameters."""
    parts = [repr(p) for p in parameters]
    for df in inputs:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        parts.append(f"{df.schema.simpleString()}:{row[0]}:{row[1]}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]
