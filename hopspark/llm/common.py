"""Shared plumbing: the folder every executor sees, scratch tables and binary files.

Nothing here keeps state on an executor's own disk.  Intermediate tables are written
with Spark's own committer to the folder named by ``spark.checkpoint.dir``, so a lost
executor costs a recomputation of its tasks and nothing else.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopspark.sources.scratch import scratch_path, scratch_table

__all__ = ["bucketed_table", "give_back", "open_file", "opens", "read_files", "scratch_path", "scratch_table", "slices", "table", "text_bytes", "write_files"]


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """:func:`scratch_table` with rows in ``buckets`` by ``key``: grouping by it later needs no shuffle of these rows.

    Buckets need a table in the catalog; it is dropped again once it has been read as a
    DataFrame, which leaves the files.
    """
    path = scratch_path(df.sparkSession, name)
    at = "hopspark_" + path.rpartition("/")[2].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(at)
    out = df.sparkSession.table(at)
    df.sparkSession.sql(f"DROP TABLE {at}")
    return out


def write_files(df: DataFrame, path: str, keys: list[str], content: str, end: bytes) -> None:
    """Write each row's binary ``content`` as a file in a folder named by its ``keys``.

    The text writer puts out a string column's bytes as they are and ends each row
    with ``lineSep``; ``end`` is therefore a byte sequence with which the file format
    may close (a trailing magic number, an empty gzip member).  Works on every file
    system Spark can write to, under Spark's commit protocol.
    """
    (
        df.select(*keys, F.col(content).cast("string").alias("value"))
        .write.partitionBy(*keys)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", end.decode("latin-1"))
        .text(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of :func:`write_files`: their keys and ``content``."""
    return spark.read.format("binaryFile").load(path)


def opens(path: str) -> bool:
    """Whether workers can open files in ``path`` (a URI as Spark writes it) piece by piece."""
    try:
        _place(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def open_file(path: str, stream: bool = False) -> pa.NativeFile:
    """A file that Spark listed, for reading by range, or from front to back with ``stream``."""
    system, name = _place(path)
    return system.open_input_stream(name, compression=None) if stream else system.open_input_file(name)


def give_back() -> None:
    """Return a Python worker's free memory to the system; workers outlive their tasks and share the executor with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of at most ``rows`` rows, so that what is made of a piece stays small; memory goes back at the end of the task."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    give_back()


def text_bytes(text: str) -> Column:
    """The text's UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
