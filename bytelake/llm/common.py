"""Helpers shared by the operators: the shared folder, written intermediate tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  Only a plain local session
    without that setting gets a temporary folder; on a cluster a missing setting is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="bytelake-llm-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


_written: list[str] = []


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts the lineage, and a
    lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bytelake-llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables ``stored`` wrote; call it when no result that reads them is needed any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(conf).delete(p, True)


SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most ``rows`` of them; beyond that it is joined by
    a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def map_rows(df: DataFrame, fn: Callable[[dict], Iterable[tuple]], schema: str, rows_per_chunk: int = 256) -> DataFrame:
    """``mapInArrow`` over small slices: ``fn`` gets ``{column: list}`` of at most ``rows_per_chunk``
    rows and returns a tuple of equally long columns (lists or numpy arrays) in ``schema`` order."""
    types = T._parse_datatype_string(schema)
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in types.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_chunk):
                part = batch.slice(at, rows_per_chunk)
                cols = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                out = fn(cols)
                arrays = [pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, types)


def filter_rows(df: DataFrame, text: str, keep: Callable[[list[str]], Iterable[bool]], rows_per_chunk: int = 256) -> DataFrame:
    """The rows whose text ``keep`` (called with the texts of at most ``rows_per_chunk`` rows, nulls as '') accepts."""
    at_column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_chunk):
                part = batch.slice(at, rows_per_chunk)
                texts = [t or "" for t in part.column(at_column).to_pylist()]
                yield part.filter(pa.array(list(keep(texts)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[t.simpleString()]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
