"""Folder scan in two Spark jobs: folders are listed by tasks, then files are read by tasks.

Spark's own file listing leaves out names that start with a dot or underscore, such as
``__init__.py``. This scan lists them all. The folder must be mounted at the same place
everywhere. Lists stay in tables: the driver sees counts only.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import text as X
from twinspan.operators.store import stage
from twinspan.sources.tables import from_table

LISTED = "path STRING, folder BOOLEAN, size BIGINT"
READ = "file STRING, size_bytes BIGINT, content BINARY"
#: Rows and bytes of an Arrow batch.
ROWS, BYTES = 10_000, 8 << 20


def list_folders(folders: DataFrame, root: str, extensions: frozenset[str], excludes: list[str]) -> DataFrame:
    """The subfolders, and the code files with their size, of each ``path`` below ``root``; links to folders are not followed.

    A folder that cannot be listed fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("path").to_pylist():
                found = []
                with os.scandir(os.path.join(root, at)) as entries:
                    for e in entries:
                        path = f"{at}/{e.name}" if at else e.name
                        if e.is_dir():
                            if not e.is_symlink() and not any(fnmatch.fnmatch(e.name, g) for g in excludes):
                                found.append((path, True, 0))
                        elif "." in e.name and e.name.rsplit(".", 1)[1].lower() in extensions:
                            found.append((path, False, e.stat().st_size))
                        if len(found) == ROWS:
                            yield _table(found)
                            found = []
                if found:
                    yield _table(found)

    return folders.select("path").mapInArrow(run, LISTED)


def _table(rows: list[tuple[str, bool, int]]) -> pa.RecordBatch:
    path, folder, size = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(folder, pa.bool_()), pa.array(size, pa.int64())], ["path", "folder", "size"])


def code_files(spark: SparkSession, root: str, extensions: frozenset[str], excludes: list[str]) -> DataFrame:
    """path, size of the code files below ``root``, listed level by level, each level by as many tasks as it has folders for."""
    level = spark.createDataFrame([("", True, 0)], LISTED)
    files = None
    while True:
        n = level.count()
        if n == 0:
            return files.select("path", "size")
        spread = level.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path")
        listed = stage(list_folders(spread, root, extensions, excludes), "folders")
        found = listed.filter("NOT folder")
        files = found if files is None else files.unionAll(found)
        level = listed.filter("folder")


def read_files(files: DataFrame, root: str, partitions: int) -> DataFrame:
    """file, size_bytes, content of the listed files, dealt by a hash of their paths."""

    def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in rows], pa.string()), pa.array([len(d) for _, d in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())],
            ["file", "size_bytes", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rows, held = [], 0
            for path in given.column("path").to_pylist():
                with open(os.path.join(root, path), "rb") as stream:
                    data = stream.read()
                rows.append((path, data))
                held += len(data)
                if held >= BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return files.select("path").repartition(partitions, "path").mapInArrow(run, READ)


def scan_source_tree(
    spark: SparkSession, root: str, extensions=C.SUPPORTED_EXTENSIONS, max_mb: float = C.MAX_FILE_SIZE_MB, exclude=(),
    max_files: int = 0, slice_bytes: int = 32 << 20,
) -> DataFrame:
    """Code files below ``root`` as ``source_files``.

    Listing runs at once, reading with the result. ``exclude`` has patterns of folder names. A file above
    ``max_mb``, or more than ``max_files`` files where that is set, is an error. Without files the result is empty.
    """
    if not os.path.isdir(root):
        raise ValueError(f"not a directory: {root}")
    kinds, excludes = ([v for v in (o.split(",") if isinstance(o, str) else o) if v] for o in (extensions, exclude))
    files = code_files(spark, root, frozenset(k.lower() for k in kinds), excludes)
    seen = files.agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max(F.struct("size", "path")).alias("largest")).first()
    if max_files and seen.n > max_files:
        raise ValueError(f"more than {max_files} code files below {root}")
    if seen.n and seen.largest.size > max_mb * 1024 * 1024:
        raise ValueError(f"{seen.largest.path} exceeds the file size limit")
    slices = max(1, min(seen.n, -(-(seen.total or 0) // slice_bytes)))
    return from_table(read_files(files, root, slices), "file", X.decode_source("content", universal_newlines=True))
