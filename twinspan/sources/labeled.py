"""Labelled pairs and expected results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions.numeric import require

LABELED = "split STRING, label INT, code_a STRING, code_b STRING, source_a STRING, source_b STRING, _corrupt_record STRING"


def read_labeled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled C pairs from JSON lines; malformed lines keep ``_corrupt_record``."""
    return spark.read.schema(LABELED).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_functions(spark: SparkSession, folder: str) -> DataFrame:
    """(id, code) of the extracted archive; duplicate ids and empty code are errors."""
    rows = spark.read.schema("idx STRING, func STRING").json(f"{folder}/dataset/data.jsonl")
    unique = rows.groupBy("idx").agg(F.count("*").alias("n"), F.min("func").alias("code"))
    ok = (F.col("n") == 1) & F.col("code").isNotNull() & F.col("code").rlike(f"[^{C.SPACE_CLASS}]")
    return unique.filter(require(ok, "duplicate function id or empty code")).select(F.col("idx").alias("id"), "code")


def read_pair_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(functions, pairs) of an extracted archive; ``ordinal`` keeps the line order."""
    parts = []
    for split in C.SPLITS:
        lines = spark.read.text(f"{folder}/dataset/{split}.txt")
        f = F.split(F.trim("value"), r"\s+")
        # Task-ordered ids keep the order of lines; only their order is used.
        row = lines.select(F.lit(split).alias("split"), f.alias("f"), F.monotonically_increasing_id().alias("ordinal"))
        ok = (F.size("f") == 3) & F.col("f")[2].isin("0", "1")
        parts.append(row.filter(require(ok, f"invalid pair in {split}")).select(
            "split", F.col("f")[0].alias("a_id"), F.col("f")[1].alias("b_id"),
            F.col("f")[2].cast("int").alias("label"), "ordinal"))
    return read_functions(spark, folder), reduce(lambda x, y: x.unionByName(y), parts)


def read_expected_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of a nested expectation file."""
    schema = (
        "scope STRING, expected_pairs ARRAY<STRUCT<type STRING,"
        " a STRUCT<name STRING, lines ARRAY<INT>>, b STRUCT<name STRING, lines ARRAY<INT>>>>"
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.explode("expected_pairs").alias("p")).select(
        F.col("p.type").alias("clone_type"),
        *[F.col(f"p.{s}.name").alias(f"name_{s}") for s in "ab"],
        *[F.col(f"p.{s}.lines")[i].alias(f"{n}_line_{s}") for s in "ab" for i, n in ((0, "start"), (1, "end"))],
    )
