"""Small helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir: the folder that the driver and all executors see.

    Where it is unset, a session of a single process (tests) gets a new folder of its own; on a cluster it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it once to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what written() has made, once the last step that reads it is itself written."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.written_at
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def give_back() -> None:
    """At the end of a task: memory that a reused Python worker would only hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose given text or binary column holds about `limit` bytes at most (one row at least)."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size + (n or 0) > limit and i > start:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, sized_by: int | None = None, limit: int = 2 << 20) -> DataFrame:
    """mapInArrow where make() runs once in each task; its result turns one batch into one.

    sized_by: the column whose bytes bound a batch, so that very long texts do not add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in [batch] if sized_by is None else slices(batch, sized_by, limit):
                if part.num_rows:
                    yield each(part)
        give_back()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def keep_rows(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], pa.Array]], limit: int = 1 << 18) -> DataFrame:
    """The rows of df, all columns, for which make()'s function of a batch of texts (of about `limit` bytes) is true; no shuffle."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in slices(batch, at, limit):
                if part.num_rows:
                    yield part.filter(keep(part.column(at)))
        give_back()

    return df.mapInArrow(run, df.schema)
