"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "bytelake", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE stays on so shuffle partition counts, skewed joins and broadcast choices are re-planned
    from runtime statistics; the UI stays off (no server).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir`` (None if unset)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return d.rstrip("/") if d else None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.  Where none is configured, a plain local session gets a
    temporary one; on a cluster that is an error, as executors don't see each other's local folders."""
    d = checkpoint_dir(spark)
    if d:
        return d
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="bytelake-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


_written: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back, so that branches share one
    computation and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/bytelake-tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_until_drop(path: str) -> str:
    """Let :func:`drop_written` delete ``path`` as well."""
    if path not in _written:
        _written.append(path)
    return path


def drop_written(spark: SparkSession) -> None:
    """Delete the tables :func:`cut_lineage` wrote and the folders of :func:`keep_until_drop`; call it when no result that reads them is
    needed any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(conf).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application: functions that run inside tasks are pickled by
    reference, so workers must be able to import it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_bytelake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="bytelake-ship-"), "bytelake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("bytelake", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._bytelake_shipped = True
