"""Tables of jobs and what belongs to them, filed by a hash of the job."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.operators.store import release, stage, staged
from twinspan.sources import shared

BUCKET = "job_bucket"
LAYOUT = "_layout.json"


class JobTables:
    """Parquet tables in one folder, each partitioned by the bucket of ``job_id``.

    A job's rows lie in one partition of each table, so that reading or deleting a job opens
    that partition alone. The number of buckets belongs to the folder and is written once;
    it should give partitions of some hundred megabytes in the largest table.
    ``jobs`` has job_id and user_id; all other tables are children with a job_id.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder = spark, folder
        if not shared.exists(spark, f"{folder}/{LAYOUT}"):
            shared.write_new(spark, f"{folder}/{LAYOUT}", json.dumps({"buckets": buckets}))
        self.buckets = json.loads(shared.read_text(spark, f"{folder}/{LAYOUT}"))["buckets"]

    def bucket(self, job_id):
        """The partition of a job, by the text of its id, whatever its type."""
        return F.pmod(F.xxhash64(job_id.cast("string")), F.lit(self.buckets)).cast("int")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows to a table. A task keeps one file open at a time; a large bucket stays split among the tasks that hold it."""
        filed = rows.withColumn(BUCKET, self.bucket(F.col("job_id")))
        filed.sortWithinPartitions(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{self.folder}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def of_job(self, name: str, job_id) -> DataFrame:
        """A job's rows, from its partition."""
        given = F.lit(job_id)
        return self.read(name).filter((F.col(BUCKET) == self._bucket_of(job_id)) & (F.col("job_id") == given)).drop(BUCKET)

    def _bucket_of(self, job_id) -> int:
        return self.spark.range(1).select(self.bucket(F.lit(job_id))).first()[0]

    def delete_job(self, job_id, user_id, children: list[str]) -> bool:
        """Delete an owned job and its rows in ``children``; whether there was one.

        Another user's job, or one that is gone, changes nothing. Only the job's partition
        of each table is rewritten. Children go first: should a rewrite fail, the job is still
        there and the next call finishes the work.
        """
        owned = self.of_job("jobs", job_id).filter(F.col("user_id") == F.lit(user_id))
        if owned.isEmpty():
            return False
        bucket = self._bucket_of(job_id)
        for name in [*children, "jobs"]:
            self._drop_rows(name, bucket, job_id)
        return True

    def _drop_rows(self, name: str, bucket: int, job_id) -> None:
        part = self.read(name).filter(F.col(BUCKET) == bucket)
        mine = F.col("job_id") == F.lit(job_id)
        if part.filter(mine).isEmpty():
            return
        known = set(staged())
        # What stays is written elsewhere first, since its partition is about to be replaced.
        left = stage(part.filter(~mine | F.col("job_id").isNull()), f"kept-{name}")
        if left.isEmpty():
            shared.delete(self.spark, f"{self.folder}/{name}/{BUCKET}={bucket}")
        else:
            left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.folder}/{name}")
        release(self.spark, [t for t in staged() if t not in known])
