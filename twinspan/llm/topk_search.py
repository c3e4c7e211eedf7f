"""Exact top-k search by inner product with a pivot table.

Inner products follow from distances: 2 q.x = |q|^2 + |x|^2 - d(q, x)^2. Distances to pivots
are computed once per vector; by the triangle inequality the largest difference of two
vectors' pivot distances is a lower bound of their own, and so an upper bound of their score.
Blocks of vectors that lie close to one pivot carry the range of each distance: pairs of
blocks that can't hold a result are dropped unread, and inside the others candidates are
evaluated in order of their bound until the bound falls below the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspan.llm.ranks import with_row_numbers
from twinspan.operators.store import stage

SCALE = 256
PIVOTS = 32
#: Vectors that pivots are chosen from.
PIVOT_SAMPLE = 2048
PIVOT_PARTS = 64
BLOCK = 2048
QUERY_BLOCK = 512
#: Block pairs per query block that give the first scores.
FIRST = 2
SALTS = 16
#: Candidates evaluated at once.
CHUNK = 256
EXACT = 2.0**53
LONG_MOST, LONG_LEAST = (1 << 63) - 1, -(1 << 63)


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim, vector BINARY: floor(256 x) of each component as doubles.

    Vectors that are null, or hold a null or a component that isn't finite, and rows without
    an id are left out.
    """
    whole = "embedding IS NOT NULL AND vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(CAST(x AS DOUBLE)) < DOUBLE('Infinity') AND NOT isnan(x))"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            vectors = [np.floor(np.asarray(v.values, np.float64) * SCALE) for v in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())],
                ["vec_id", "dim", "vector"])

    return rows.mapInArrow(run, "vec_id LONG, dim INT, vector BINARY")


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension, vectors far from each other, from a sample by hashes of their ids.

    Ids fall into parts by one hash and the smallest other hashes of each part are the sample: few
    ranks a part, so that tasks cut their rows before any of them move. The vectors
    of a sample meet in one task, its pivots alone come to the driver.
    """
    part = F.pmod(F.hash("vec_id"), F.lit(PIVOT_PARTS))
    order = [F.xxhash64("vec_id"), F.col("vec_id"), F.md5("vector")]
    rank = F.row_number().over(Window.partitionBy("dim", "_part").orderBy(*order))
    sample = vectors.withColumn("_part", part).withColumn("_rank", rank).filter(F.col("_rank") <= PIVOT_SAMPLE // PIVOT_PARTS)

    def far(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_part", "ascending"), ("_rank", "ascending")])
        dim = table["dim"][0].as_py()
        x = _matrix(table["vector"].combine_chunks(), dim)
        chosen = [0]
        nearest = _distances(x, x[:1])[:, 0]
        while len(chosen) < min(PIVOTS, len(x)):
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _distances(x, x[chosen[-1:]])[:, 0])
        return pa.table({"dim": pa.array([dim] * len(chosen), pa.int32()), "turn": pa.array(range(len(chosen)), pa.int32()),
                         "vector": pa.array([x[i].tobytes() for i in chosen], pa.binary())})

    found: dict[int, list[np.ndarray]] = {}
    pivots = sample.select("dim", "vector", "_part", "_rank").groupBy("dim").applyInArrow(far, "dim INT, turn INT, vector BINARY")
    for r in sorted(pivots.collect(), key=lambda r: (r["dim"], r["turn"])):
        found.setdefault(r["dim"], []).append(np.frombuffer(r["vector"], np.float64))
    return {dim: np.stack(rows) for dim, rows in found.items()}


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, from differences, so that small ones keep their digits."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _matrix(binary: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), np.float64).reshape(len(binary), dim)


def with_cells(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Append the nearest pivot ``cell`` and the distance ``near`` to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, near = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in set(dims.tolist()):
                pick = np.flatnonzero(dims == dim)
                d = _distances(_matrix(batch.column("vector").take(pa.array(pick)), dim), pivots[dim])
                cell[pick], near[pick] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near)], [*batch.schema.names, "cell", "near"])

    return vectors.mapInArrow(run, "vec_id LONG, dim INT, vector BINARY, cell INT, near DOUBLE")


_BLOCK_SCHEMA = (
    "block LONG, dim INT, n INT, rows BINARY, ids BINARY, vectors BINARY, table BINARY, "
    "low ARRAY<DOUBLE>, high ARRAY<DOUBLE>, norm DOUBLE")


def into_blocks(numbered: DataFrame, size: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """One row per ``size`` neighbours of one dimension: ids, vectors, pivot table and its ranges.

    ``numbered`` has ``row``, the row's name among all vectors, and ``place`` in the order.
    """

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        dim = table["dim"][0].as_py()
        x = _matrix(table["vector"].combine_chunks(), dim)
        d = _distances(x, pivots[dim])
        value = {
            "block": table["block"][0].as_py(), "dim": dim, "n": len(x), "rows": table["row"].to_numpy().tobytes(),
            "ids": table["vec_id"].to_numpy().tobytes(), "vectors": x.tobytes(), "table": d.tobytes(),
            "low": d.min(axis=0).tolist(), "high": d.max(axis=0).tolist(), "norm": float((x**2).sum(axis=1).max())}
        kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(value.items(), kinds, strict=True)})

    # Neighbours of different dimensions don't share a block.
    blocked = numbered.withColumn("block", F.expr(f"(place DIV {size}) * {1 << 20} + dim"))
    return blocked.groupBy("block").applyInArrow(pack, _BLOCK_SCHEMA)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 53 bits in whole numbers, kept within a LONG."""
    if q.shape[-1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([min(LONG_MOST, max(LONG_LEAST, sum(a * int(b) for a, b in zip(whole, r, strict=True)))) for r in x], np.int64)


def search_block(queries: dict, candidates: dict, floors: np.ndarray | None, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(query row, query id, candidate id, score) of what may be among a query's k best.

    ``floors`` has a score per query below which nothing is wanted.
    """
    qx, qd = queries["vectors"], queries["table"]
    cx, cd = candidates["vectors"], candidates["table"]
    q_norm, c_norm = (qx**2).sum(axis=1), (cx**2).sum(axis=1)
    for i in range(len(qx)):
        gap = np.abs(cd - qd[i]).max(axis=1)
        # A little over the bound, for the rounding of distances.
        bound = (q_norm[i] + c_norm - gap**2) / 2 + 1e-6 * (q_norm[i] + c_norm) + 1
        least = -np.inf if floors is None else floors[i]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= least]
        best: list[tuple[int, int]] = []
        for a in range(0, len(order), CHUNK):
            if bound[order[a]] < least:
                break
            pick = order[a : a + CHUNK]
            pick = pick[candidates["rows"][pick] != queries["rows"][i]]
            scores = _scores(qx[i], cx[pick])
            wanted = scores >= least
            best += [(-s, vec) for s, vec in zip(scores[wanted].tolist(), candidates["ids"][pick][wanted].tolist(), strict=True)]
            best = sorted(best)[:k]
            if len(best) == k:
                least = max(least, -best[-1][0])
        for minus, vec in best:
            yield int(queries["rows"][i]), int(queries["ids"][i]), vec, -minus


def _evaluate(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Rows of search_block for pairs (query_block, block[, floors])."""
    fields = ["rows", "ids", "vectors", "table"]
    side = lambda df, p: df.select(F.col("block").alias(p), F.struct("dim", "n", *fields).alias(f"{p}_data"))
    joined = pairs.join(side(queries, "query_block"), "query_block").join(side(blocks, "other"), "other")
    has_floors = "floors" in pairs.columns

    def opened(row: dict) -> dict:
        kinds = {"rows": np.int64, "ids": np.int64, "vectors": np.float64, "table": np.float64}
        out = {c: np.frombuffer(row[c], t) for c, t in kinds.items()}
        return out | {"vectors": out["vectors"].reshape(row["n"], row["dim"]), "table": out["table"].reshape(row["n"], -1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = (opened(batch.column(f"{p}_data")[i].as_py()) for p in ("query_block", "other"))
                floors = np.array(batch.column("floors")[i].as_py(), float) if has_floors else None
                found = list(search_block(q, c, floors, k))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["row", "query_id", "vec_id", "score"])

    columns = ["query_block_data", "other_data", *(["floors"] if has_floors else [])]
    # Few rows, each much work: one task per few pairs, dealt by their numbers, the same in every attempt.
    return joined.select("query_block", "other", *columns).repartition("query_block", "other").mapInArrow(run, "row LONG, query_id LONG, vec_id LONG, score LONG")


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def block_pairs(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_block, other, bound, turn: the score no row of a pair exceeds, and its rank for the query block.

    Only numbers of blocks meet here, thousands of vectors each; salts spread them.
    """
    shape = lambda df, p: df.select(
        "dim", F.col("block").alias(f"{p}_block"), *[F.col(c).alias(f"{p}_{c}") for c in ("low", "high", "norm")])
    q = shape(queries, "query").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    c = shape(blocks, "other").withColumn("salt", F.pmod(F.hash("other_block"), F.lit(SALTS)))
    apart = lambda a, b: F.zip_with(f"{a}_low", f"{b}_high", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    gap = F.greatest(F.array_max(apart("query", "other")), F.array_max(apart("other", "query")))
    norms = F.col("query_norm") + F.col("other_norm")
    bound = (norms - gap * gap) / 2 + 1e-6 * norms + 1
    pairs = q.join(c, ["dim", "salt"]).select("query_block", F.col("other_block").alias("other"), bound.alias("bound"))
    order = Window.partitionBy("query_block").orderBy(F.desc("bound"), "other")
    return pairs.withColumn("turn", F.row_number().over(order))


def _floors(query_blocks: DataFrame, begun: DataFrame, k: int) -> DataFrame:
    """query_block, floors, least: the k-th score so far of each query in its block's order, and the block's least.

    A query with fewer than k scores has no floor yet.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(r, np.int64) for r in batch.column("rows").to_pylist()]
            sizes = [len(h) for h in held]
            block = np.repeat(batch.column("block").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(np.concatenate(held)), pa.array(np.concatenate([np.arange(n) for n in sizes]))],
                ["query_block", "row", "place"])

    members = query_blocks.select("block", "rows").mapInArrow(rows, "query_block LONG, row LONG, place LONG")
    kth = _best(begun, k).filter(F.col("rank") == k).select("row", F.col("score").cast("double").alias("floor"))
    floor = F.coalesce("floor", F.lit(float("-inf")))
    return members.join(kth, "row", "left").groupBy("query_block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", floor.alias("floor")))), lambda x: x["floor"]).alias("floors"),
        F.min(floor).alias("least"))


def top_k(embeddings: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row for which ``is_query`` holds.

    Ties go to the smaller vec_id. Vectors of one length are compared with each other. Rows
    that repeat an id are queries and candidates of their own. Scores that a LONG can't hold
    stay at its ends. Further columns are not read; an empty table gives no row.
    """
    vectors = stage(quantised(embeddings), "topk-vectors")
    pivots = choose_pivots(vectors)
    # Spark samples the keys of a sort to the driver: a digest stands for the vector.
    order = [*[F.col(c) for c in ("dim", "cell", "near", "vec_id")], F.md5("vector")]
    numbered = with_row_numbers(with_cells(vectors, pivots), order, "topk-order").withColumnRenamed("row_number", "row")
    blocks = stage(into_blocks(numbered.withColumn("place", F.col("row")), BLOCK, pivots), "topk-blocks")
    asked = with_row_numbers(numbered.filter(is_query), [F.col("row")], "topk-queries").withColumnRenamed("row_number", "place")
    queries = stage(into_blocks(asked, QUERY_BLOCK, pivots), "topk-query-blocks")
    pairs = stage(block_pairs(queries, blocks), "topk-pairs")
    first = pairs.filter(F.col("turn") <= FIRST).select("query_block", "other")
    begun = stage(_evaluate(first, queries, blocks, k), "topk-first")
    rest = pairs.filter(F.col("turn") > FIRST).join(_floors(queries, begun, k), "query_block").filter("bound >= least")
    more = _evaluate(rest.select("query_block", "other", "floors"), queries, blocks, k)
    return _best(begun.unionAll(more), k).select("query_id", "rank", "vec_id", "score")
