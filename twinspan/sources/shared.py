"""Small files and folders on whatever file system a path names, through Spark's own access to it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def exists(spark: SparkSession, path: str) -> bool:
    fs, name = _at(spark, path)
    return fs.exists(name)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; whether there was one."""
    fs, name = _at(spark, path)
    return fs.delete(name, True)


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet: of two writers at once, one fails."""
    fs, name = _at(spark, path)
    out = fs.create(name, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, name = _at(spark, path)
    stream = fs.open(name)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
