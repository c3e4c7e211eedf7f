"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.operators.store import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    return down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(own).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root LONG for every node of an edge: the least node it is connected with.

    ``edges`` has LONG columns a and b. Each round is written, so lineage stays short; the
    rounds end when the edges no longer change. Star hubs of any degree cost one row per edge.
    """
    at = stage(edges.filter("a != b").select("a", "b").distinct(), f"{name}-edges")
    if at.isEmpty():
        return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark, step = None, 0
    while True:
        at = stage(_small_star(_large_star(at)), f"{name}-{step}")
        new = at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 32))).first()
        if new == mark:
            break
        mark, step = new, step + 1
    roots = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
