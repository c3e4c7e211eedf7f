"""Global row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinspan.operators.store import stage


def _running(df: DataFrame, value: str) -> DataFrame:
    """Append ``_sum``: the sum of ``value`` over the partition's rows so far, this one included."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sums = total + np.cumsum(batch.column(names.index(value)).to_numpy())
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*names, "_sum"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("_sum", LongType())]))


def with_row_numbers(df: DataFrame, order: list[Column], name: str, value: str | None = None) -> DataFrame:
    """Append ``row_number`` LONG: 0 for the first row in ``order``, and so on without gaps.

    With ``value``, the name of a LONG column without nulls, also ``running`` LONG: the sum of
    it over all rows up to and including this one.

    Rows are sorted across range partitions and written once; a row's place is its place in
    its partition plus the rows of the partitions before. Only one count and sum per partition
    meet in one place. Ties are split between partitions by input place, so one value may
    hold any share of the rows; rows equal in ``order`` should be equal in every column,
    then the numbered table is the same in each run. An empty table stays empty.
    """
    kept = df.columns
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = _running(placed, value) if value else placed.withColumn("_sum", F.lit(0).cast("long"))
    rows = stage(placed, name)
    part = F.shiftright("_place", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.max("_sum").alias("total"))
    # One row per partition of the sort, whatever the number of rows.
    before, n, total = [], 0, 0
    for r in sorted(counts.collect()):
        before.append((r["_part"], n, total))
        n, total = n + r["n"], total + r["total"]
    starts = df.sparkSession.createDataFrame(before, "_part LONG, _rows LONG, _before LONG")
    numbered = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    place = F.col("_place").bitwiseAND((1 << 33) - 1)
    sums = [(F.col("_before") + F.col("_sum")).alias("running")] if value else []
    return numbered.select(*kept, (F.col("_rows") + place).alias("row_number"), *sums)
