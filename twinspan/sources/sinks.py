"""Writers. All of them are ordinary Spark output, one file per task."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from twinspan.operators.rollups import region_report
from twinspan.sources import shared

MANIFEST = "_run.json"


def write_clone_pairs(pairs: DataFrame, path: str, mode: str = "append") -> None:
    """Pairs by job. ``mode="replace"`` puts these jobs' pairs in the place of what they had,
    so that a repeated write changes nothing; other jobs keep theirs."""
    if mode == "replace":
        pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)
    else:
        pairs.write.mode(mode).partitionBy("job_id").parquet(path)


def export_json(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("errorifexists").json(path)


def export_csv(pairs: DataFrame, path: str) -> None:
    """The seven report columns with a header, quoted where needed."""
    region_report(pairs).write.mode("errorifexists").option("header", True).csv(path)


def write_run(outputs: dict[str, DataFrame], folder: str) -> None:
    """Audit, pairs, predictions and report of a run, all or none; an existing run is never overwritten.

    Tables are written to a folder of this attempt. The manifest that names them comes
    last and makes the run exist: a failed table leaves nothing to read, a retry starts anew, and
    of two writers at once one fails.
    """
    if not outputs:
        raise ValueError("a run without tables")
    spark = next(iter(outputs.values())).sparkSession
    if shared.exists(spark, f"{folder}/{MANIFEST}"):
        raise FileExistsError(f"a run already exists in {folder}")
    attempt = f"attempt-{uuid.uuid4().hex}"
    try:
        for name, df in outputs.items():
            df.write.mode("errorifexists").json(f"{folder}/{attempt}/{name}")
        tables = {name: {"path": f"{attempt}/{name}", "schema": df.schema.jsonValue()} for name, df in outputs.items()}
        shared.write_new(spark, f"{folder}/{MANIFEST}", json.dumps({"tables": tables}))
    except BaseException:
        shared.delete(spark, f"{folder}/{attempt}")
        raise


def read_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a complete run, with the types they were written with."""
    if not shared.exists(spark, f"{folder}/{MANIFEST}"):
        raise FileNotFoundError(f"no complete run in {folder}")
    tables = json.loads(shared.read_text(spark, f"{folder}/{MANIFEST}"))["tables"]
    return {name: spark.read.schema(StructType.fromJson(t["schema"])).json(f"{folder}/{t['path']}") for name, t in tables.items()}
