"""Binding text tables to the source-file shape, and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import text as X
from twinspan.functions.numeric import require


def from_table(
    df: DataFrame,
    file: str | Column,
    content: str | Column,
    language: str | Column | None = None,
    file_ord: str | Column | None = None,
    job_id: str | Column | None = None,
) -> DataFrame:
    """``source_files(job_id, file, file_ord, language, content)`` from any table.

    Without ``language`` it follows from the extension; without ``file_ord`` files
    keep the order of a top-down folder walk.
    """
    path = X.normalise_path(file)
    return df.select(
        (X.col(job_id) if job_id is not None else F.lit("all")).alias("job_id"),
        path.alias("file"),
        (X.col(file_ord) if file_ord is not None else X.walk_key(path)).alias("file_ord"),
        (X.col(language) if language is not None else X.detect_language(path)).alias("language"),
        X.col(content).alias("content"),
    )


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """Read parquet; spread it when the scan has fewer splits than the cluster cores.

    A large table has more splits than cores and is read as it lies, without shuffle.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def supported_only(files: DataFrame) -> DataFrame:
    return files.filter(X.is_supported("file"))


def check_file_size(
    files: DataFrame, max_mb: float = C.MAX_FILE_SIZE_MB, mode: str = "fail"
) -> DataFrame:
    """Fail on, or drop, files above the limit. The limit is in bytes."""
    fits = F.octet_length("content") <= int(max_mb * 1024 * 1024)
    if mode == "drop":
        return files.filter(fits)
    return files.filter(require(fits, f"a file exceeds the {max_mb} MB limit"))


def duplicate_paths(files: DataFrame) -> DataFrame:
    """(job_id, file, n) of paths that occur more than once in a job."""
    return (
        files.groupBy("job_id", X.normalise_path("file").alias("file"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )


def first_of_each_path(files: DataFrame) -> DataFrame:
    """Keep the file with the lowest ``file_ord`` for each path of a job."""
    cols = [c for c in files.columns if c not in ("job_id", "file")]
    best = F.min_by(F.struct(*cols), F.struct("file_ord", F.xxhash64("content")))
    return (
        files.groupBy("job_id", X.normalise_path("file").alias("file"))
        .agg(best.alias("r"))
        .select("job_id", "file", "r.*")
        .select(*files.columns)
    )


def ingest_counts(files: DataFrame) -> DataFrame:
    """Per job: all files, those that are code, those that are skipped."""
    code = X.is_supported(X.normalise_path("file"))
    return files.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.count_if(code).alias("code_files"),
        F.count_if(~code).alias("skipped_files"),
    )


def lookup_source(files: DataFrame, jobs: DataFrame, job_id, user_id, path: str) -> DataFrame:
    """One stored file, visible only to the owner of its job."""
    mine = jobs.filter((F.col("job_id") == job_id) & (F.col("user_id") == user_id))
    return (
        files.filter((F.col("job_id") == job_id) & (F.col("file") == path))
        .join(mine.select("job_id"), "job_id", "left_semi")
        .select("file", "language", "content")
    )
