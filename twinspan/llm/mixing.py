"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same fractional number of copies, target / source size.
Its whole part is taken as it is; the rest is a probability. Pairs of probabilities trade
word mass at random until one is 0 or 1, which keeps the expected copies of each document
and the words of the source: after the last pair, a source is off its target by less than
the one document that was left. Leaves of equal row count are rounded apart, and the one
document each leaf leaves open per source meets the others in a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.llm.carried import Carried
from twinspan.llm.ranks import with_row_numbers
from twinspan.llm.symbols import mix
from twinspan.operators.store import stage

SPACED = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
LEAF = 4096
FAN_IN = 64
SEED = 7


def word_count(text) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def target_sizes(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Target words per source: ``share`` of all words by weight, at most ``most`` times a source.

    What a full source can't take is shared again among the others by weight. Sources are in
    code point order, null last, and the weights repeat along them.
    """
    names = sorted((s for s, _ in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s, _ in sizes if s is None]
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(size.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] >= most * size[s]]
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * size[s]
        left = max(0.0, left - sum(target[s] for s in full))
        open_ = [s for s in open_ if s not in target]
    return target


def _round(keys: np.ndarray, size: np.ndarray, chance: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Pairs in order until all but one chance is 0 or 1; the index of that one, or -1.

    A document without words carries no mass and is rounded by itself.
    """
    draws = mix(keys.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype(np.float64) / 2.0**64
    out = chance.copy()
    empty = size <= 0
    out[empty] = draws[empty] < out[empty]
    held = -1
    p, s, u = out.tolist(), size.tolist(), draws.tolist()
    for i in np.flatnonzero(~empty & (out > 0) & (out < 1)).tolist():
        if held < 0:
            held = i
            continue
        j = held
        up = min((1 - p[i]) * s[i], p[j] * s[j])      # words that may move from j to i
        down = min(p[i] * s[i], (1 - p[j]) * s[j])    # or from i to j
        move = up if u[i] * (up + down) < down else -down
        p[i], p[j] = _snap(p[i] + move / s[i]), _snap(p[j] - move / s[j])
        open_ = [k for k in (i, j) if 0 < p[k] < 1]
        # Both are settled when they fill or empty each other exactly.
        held = open_[0] if open_ else -1
    return np.array(p), held


def _snap(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _rounder(last: bool, seed: int):
    def run(table: pa.Table) -> pa.Table:
        # Large documents settle among themselves first, so that what stays open is small.
        table = table.sort_by([("size", "descending"), ("row_number", "ascending")])
        draw, size, chance = (table[c].to_numpy() for c in ("draw", "size", "chance"))
        done, held = _round(draw, size, chance, seed)
        if last and held >= 0:
            u = mix(draw[held : held + 1].astype(np.uint64) ^ np.uint64(seed + 1)).astype(np.float64)[0] / 2.0**64
            done[held], held = float(u < done[held]), -1
        for name, values in (("chance", done), ("settled", np.arange(len(done)) != held)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
        return table

    return run


def mix_sources(
    rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, layout: str | None = None
) -> DataFrame:
    """Append source_size LONG, target DOUBLE and copies LONG to rows with source and size.

    Input columns: ``source``, ``size`` and any that name the row. Equal input gives equal
    output in every run: leaves follow a hash of the columns, all but ``layout``, which may
    depend on how the input is stored. A source without words gets target 0 and no copies.
    An empty table stays empty.
    """
    spark = rows.sparkSession
    kept = rows.columns
    named = [c for c in kept if c != layout]
    # The number of sources is the number of entries of the mixing recipe.
    sizes = [(r["source"], int(r["n"] or 0)) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    target = target_sizes(sizes, weights, share, most)
    plan = spark.createDataFrame(
        [(s, n, float(target[s]), min(most, target[s] / n) if n else 0.0) for s, n in sizes],
        "source STRING, source_size LONG, target DOUBLE, rate DOUBLE")
    plan = plan.withColumnRenamed("source", "_source")
    numbered = with_row_numbers(
        rows.withColumn("draw", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in named])),
        [F.col("source"), F.col("draw"), *[F.col(c) for c in [*named, *([layout] if layout else [])] if c != "source"]], "mix-order")
    open_ = numbered.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumns({
        "whole": F.floor("rate"), "chance": F.col("rate") - F.floor("rate"),
        # Repeated rows share their hash; their row numbers tell the draws apart.
        "draw": F.xxhash64("draw", "row_number"), "settled": F.lit(False), "leaf": F.expr(f"row_number DIV {LEAF}")})
    columns = open_.columns
    schema = open_.schema
    n_leaves = -(-max(1, numbered.count()) // LEAF)
    parts, level = [], 0
    while True:
        last = n_leaves == 1
        done = stage(
            open_.groupBy("leaf", "source").applyInArrow(_rounder(last, seed + 2 * level), schema), f"mix-level{level}")
        parts.append(done.filter("settled"))
        if last:
            break
        # One open document per leaf and source goes up.
        open_ = done.filter("NOT settled").withColumn("leaf", F.expr(f"leaf DIV {FAN_IN}")).select(*columns)
        n_leaves, level = -(-n_leaves // FAN_IN), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select(*kept, "source_size", "target", (F.col("whole") + F.round("chance")).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for each row of ``docs``.

    size counts words (null text: 0); taken counts the words the mix takes from the row,
    repeats included. Null and repeated ids are rows like others.
    """
    mixed = mix_sources(docs.select("doc_id", "source", word_count("text").alias("size")), weights, share, most, seed)
    return mixed.select("doc_id", "size", "source", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``.

    Rows are numbered in a written table first, so that equal ids don't meet in the join.
    """
    held = Carried(docs)
    rows = stage(held.df.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    named = rows.select(
        "row", held.col("doc_id").alias("doc_id"), held.col("source").alias("source"),
        word_count(held.col("text")).alias("size"), F.xxhash64(held.col("text")).alias("text"))
    copies = mix_sources(named, weights, share, most, seed, "row").filter("copies > 0").select("row", "copies")
    taken = rows.join(copies, "row")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*held.back())
