"""Embedding each distinct code once, with a cache table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.functions.numeric import require, valid_vector
from twinspan.operators.segment import once
from twinspan.operators.store import stage
from twinspan.sources import shared


def code_key(code: str = "code"):
    return F.sha2(F.col(code), 256)


def valid_cache(cache: DataFrame, dim: int, ttl_seconds: int | None = None, now=None) -> DataFrame:
    """Rows of the right length that are younger than the time to live."""
    rows = cache.filter(F.size("vector") == dim)
    if ttl_seconds is not None:
        age = F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("stored_at")
        rows = rows.filter(age < ttl_seconds)
    return rows


def wanted_codes(frags: DataFrame) -> DataFrame:
    """Each distinct code once, by its key."""
    return frags.select(code_key().alias("key"), "code", "language").groupBy("key").agg(
        F.first("code").alias("code"), F.min("language").alias("language"))


def cache_misses(frags: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct codes without a valid cache row."""
    return wanted_codes(frags).join(cache.select("key"), "key", "left_anti")


def look_up(frags: DataFrame, known: DataFrame, buckets: int | None = None) -> DataFrame:
    """key, code, language, vector of each distinct code, the vector null where ``known`` has none.

    The latest row of a key counts. With the ``buckets`` of a bucketed cache the codes move to its
    buckets and the cache itself stays where it is; what goes on from here has the size of
    the codes asked for, not of the cache.
    """
    wanted = wanted_codes(frags)
    wanted = wanted.repartition(buckets, "key") if buckets else wanted
    latest = F.max_by("vector", "stored_at") if "stored_at" in known.columns else F.max("vector")
    met = wanted.join(known, "key", "left")
    return met.groupBy("key").agg(F.first("code").alias("code"), F.first("language").alias("language"), latest.alias("vector"))


def embed_with_cache(
    frags: DataFrame, cache: DataFrame, provider: Callable[[DataFrame], DataFrame], dim: int,
    ttl_seconds: int | None = None, buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(fragments with vectors, rows to add to the cache).

    ``provider`` maps (key, code, language) rows to (key, vector) rows, for instance by
    an iterator UDF that loads its model once per worker. Each missing code is embedded once:
    its vector is bound before it is checked, and written before it is used. Bad vectors
    fail the job. The cache is read once, by ``look_up``.
    """
    met = stage(look_up(frags, valid_cache(cache, dim, ttl_seconds), buckets), "embedding-cache")
    missing = met.filter("vector IS NULL").drop("vector")
    given = once(provider(missing), "_vector", F.col("vector")).select("key", F.col("_vector").alias("vector"))
    fresh = stage(given.filter(require(valid_vector("vector", dim), "the model returned an invalid vector")), "vectors")
    both = met.filter("vector IS NOT NULL").select("key", "vector").unionByName(fresh)
    return frags.withColumn("key", code_key()).join(both, "key"), fresh.withColumn("stored_at", F.current_timestamp())


class EmbeddingCache:
    """A cache table in a shared folder, bucketed by key, so that a lookup never shuffles it.

    The newest ``_v<n>.json`` names the folder of the data and its number of buckets; the number
    should be at least that of shuffle partitions. ``compact`` writes a new version without
    expired, repeated and unfit rows; readers of the version before it go on undisturbed,
    older ones are deleted. Rows appended while it runs may be lost and are embedded again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 200, vector_type: str = "array<double>"):
        self.spark, self.folder, self.vector_type = spark, folder, vector_type
        if not shared.exists(spark, self._version(1)):
            self._publish(1, buckets)

    def _version(self, n: int) -> str:
        return f"{self.folder}/_v{n}.json"

    def _publish(self, n: int, buckets: int, data: str | None = None) -> None:
        data = data or f"data-{uuid.uuid4().hex}"
        shared.write_new(self.spark, self._version(n), json.dumps({"data": data, "buckets": buckets}))

    def _newest(self) -> tuple[int, dict]:
        n = 1
        while shared.exists(self.spark, self._version(n + 1)):
            n += 1
        return n, json.loads(shared.read_text(self.spark, self._version(n)))

    def _table(self, data: str, buckets: int) -> str:
        name = f"embedding_cache_{data.replace('-', '_')}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (key STRING, vector {self.vector_type}, stored_at TIMESTAMP) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self.folder}/{data}'")
        return name

    @property
    def buckets(self) -> int:
        return self._newest()[1]["buckets"]

    def read(self) -> DataFrame:
        return self.spark.table(self._table(**self._newest()[1]))

    def append(self, rows: DataFrame) -> None:
        """Add (key, vector, stored_at) rows, one file per bucket."""
        at = self._newest()[1]
        self._insert(rows, self._table(**at), at["buckets"])

    def _insert(self, rows: DataFrame, table: str, buckets: int) -> None:
        rows.select("key", F.col("vector").cast(self.vector_type).alias("vector"), "stored_at").repartition(buckets, "key").write.insertInto(table)

    def embed(self, frags: DataFrame, provider: Callable[[DataFrame], DataFrame], dim: int, ttl_seconds: int | None = None) -> DataFrame:
        """Fragments with vectors; new ones join the cache."""
        at = self._newest()[1]
        out, fresh = embed_with_cache(frags, self.read(), provider, dim, ttl_seconds, at["buckets"])
        self._insert(fresh, self._table(**at), at["buckets"])
        return out

    def compact(self, dim: int, ttl_seconds: int | None = None, buckets: int | None = None) -> None:
        """A new version with the latest valid row of each key, also to change the number of buckets."""
        n, at = self._newest()
        data, buckets = f"data-{uuid.uuid4().hex}", buckets or at["buckets"]
        rows = valid_cache(self.read(), dim, ttl_seconds).groupBy("key").agg(
            F.max_by("vector", "stored_at").alias("vector"), F.max("stored_at").alias("stored_at"))
        self._insert(rows, self._table(data, buckets), buckets)
        self._publish(n + 1, buckets, data)
        if n > 1:
            old = json.loads(shared.read_text(self.spark, self._version(n - 1)))
            shared.delete(self.spark, f"{self.folder}/{old['data']}")
