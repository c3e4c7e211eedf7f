"""Cutting lineage with tables in the shared checkpoint folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from twinspan.session import checkpoint_dir

#: Bytes of rows that Spark hands to Python at a time, about: Spark's own 64 MB take several times that in a task.
BATCH = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Folders written by this process and not released yet.
_written: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; ``release`` knows it from now on."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs that run meanwhile hand Python about ``size`` bytes at a time; a smaller setting of the session stays."""
    before = spark.conf.get(BATCH_BYTES, None)
    if before is None or not before.isdigit() or not 0 < int(before) < size:
        spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before) if before is not None else spark.conf.unset(BATCH_BYTES)


def stage(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later plans scan only the columns they need, the work is not repeated on both
    sides of a self-join, and a lost executor costs a re-read instead of a recompute.
    ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    with batches_of(spark, BATCH):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_store(path: str | None) -> tuple[fs.FileSystem, str] | None:
    """The store of a file of Spark's and its path there; None where Arrow knows no such store or can't reach the file."""
    if path is None:
        return None
    local = re.match("(?:file:)?(?://)?(/[^/].*)", path)
    try:
        system, at = (fs.LocalFileSystem(), unquote(local[1])) if local else fs.FileSystem.from_uri(path)
        return (system, at) if system.get_file_info(at).is_file else None
    except (pa.ArrowException, OSError):
        return None


def staged() -> list[str]:
    """The folders staged by this process and not released."""
    return list(_written)


def release(spark: SparkSession, folders: list[str], keep: DataFrame | None = None) -> int:
    """Delete staged tables once nothing reads them any more.

    Results are lazy and read staged tables: write or collect them first. The tables that
    ``keep`` reads stay. Returns how many folders are gone.
    """
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    read = keep.inputFiles() if keep is not None else []
    gone = 0
    for name in folders:
        if name in _written and not any(f"/{name.rsplit('/', 1)[1]}/" in f for f in read):
            _written.remove(name)
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            gone += bool(path.getFileSystem(hadoop).delete(path, True))
    return gone
