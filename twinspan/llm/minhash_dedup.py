"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles. Each of its samples is one
shingle with a level, drawn so that two documents agree on a sample as often as their
weighted Jaccard similarity says. Documents that agree on a band of samples meet; those
whose whole signatures agree well enough form families; inside a family the similarity is
computed from the full sets, and only links of at least the threshold join documents.

Equal word sequences are one node throughout. Everything that leaves a task is linear in
its rows: a bucket or family gives a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.llm.anchors import NO_ID, keyed
from twinspan.llm.carried import Carried
from twinspan.llm.components import components
from twinspan.llm.symbols import blocks, chained, mix, signed, text_buffers, word_hashes
from twinspan.operators.store import stage

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 meets in a band with probability 0.998, one of 0.3 with 0.09.
BANDS = 12
ROWS = 4
SAMPLES = BANDS * ROWS
#: Share of equal samples below which a pair isn't looked at; 3.5 deviations under the threshold.
AGREEMENT = 0.6
#: Documents per shingle are counted in so many hashed cells: 2 MB whatever the corpus.
CELLS = 1 << 18
CELL_ROWS = 64
#: A shingle in at most this share of the documents weighs 1, whatever its frequency; one in
#: all documents weighs so much less. Were rare shingles heavier still, members of large groups
#: of near copies would lose their links to the few words that tell them apart.
COMMON = 1 / 64
COMMON_LOSS = 0.1
#: Nodes of a bucket, and shingles of a family, that are compared in one task.
TILE = 4096
FAMILY_TILE = 2_000_000
_BITS = 52


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of 65,536 equal parts."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.where(u < 0.5, np.sqrt(2 * u), 1 - np.log1p(-u))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 4)
    return x


_GAMMA = _gamma_quantiles()
_R = _GAMMA.astype(np.float32)
_R_INVERSE = (1 / _GAMMA).astype(np.float32)
_LOG_C = np.log(_GAMMA).astype(np.float32)
_BETA = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


@dataclass
class Shingles:
    """Distinct shingles of a block of rows, sorted by row and hash."""

    hashes: np.ndarray
    counts: np.ndarray
    #: Where each row's shingles begin.
    offsets: np.ndarray
    #: Hash of each row's whole word sequence.
    digests: np.ndarray
    n_words: np.ndarray


def shingles(data: np.ndarray, offsets: np.ndarray) -> Shingles:
    """Shingles of a block of at most 4,095 rows; a row of one to four words has one, all its words."""
    values, rows = word_hashes(data, offsets)
    n_words = np.diff(rows)
    # Each word is scrambled with its place in the row, then the row's are summed.
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(rows[:-1], n_words).astype(np.uint64)
    running = np.append(np.uint64(0), np.cumsum(mix(values ^ mix(place + np.uint64(1)))))
    digests = mix((running[rows[1:]] - running[rows[:-1]]) ^ mix(n_words.astype(np.uint64) + np.uint64(1)))
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(n_words)), counts)
    start = rows[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = np.zeros(len(start), np.uint64)
    width = np.minimum(n_words, SHINGLE)[row]
    for size in range(1, SHINGLE + 1):
        these = width == size
        grams[these] = chained(values, size)[start[these]]
    packed = (row.astype(np.uint64) << np.uint64(_BITS)) | (grams >> np.uint64(64 - _BITS))
    packed, times = np.unique(packed, return_counts=True)
    at = np.searchsorted(packed >> np.uint64(_BITS), np.arange(len(n_words) + 1, dtype=np.uint64))
    return Shingles(packed & np.uint64((1 << _BITS) - 1), times, at, digests, n_words)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Shingles]]:
    data, offsets = text_buffers(batch.column("text"))
    for low, high in blocks(offsets):
        for a in range(low, high, 4000):
            b = min(high, a + 4000)
            yield a, b, shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


def idf_weights(docs: DataFrame) -> np.ndarray:
    """Weight of each hashed cell of shingles, from the documents of the whole input that hold one.

    Each task counts into one array; arrays are summed cell block by cell block, so what comes
    back is 2 MB for any input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS, np.int64)
        n = 0
        for batch in batches:
            for _, _, s in _blocks(batch):
                cells = _cells(s.hashes)
                row = np.repeat(np.arange(len(s.n_words)), np.diff(s.offsets))
                held += np.bincount(np.unique(row * CELLS + cells) % CELLS, minlength=CELLS)
                n += len(s.n_words)
        parts = held.astype("<i8").reshape(CELL_ROWS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CELL_ROWS)), pa.array([p.tobytes() for p in parts]), pa.array([n] * CELL_ROWS, pa.int64())],
            ["part", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for part, counts, n in zip(*(batch.column(c).to_pylist() for c in ("part", "counts", "n")), strict=True):
                old, m = sums.get(part, (0, 0))
                sums[part] = old + np.frombuffer(counts, "<i8"), m + n
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([c.tobytes() for c, _ in sums.values()]), pa.array([n for _, n in sums.values()], pa.int64())],
                ["part", "counts", "n"])

    schema = "part LONG, counts BINARY, n LONG"
    sums = docs.select("text").mapInArrow(count, schema).repartition(CELL_ROWS, "part").mapInArrow(add, schema).collect()
    held, n = np.zeros((CELL_ROWS, CELLS // CELL_ROWS)), 0
    for r in sums:
        held[r["part"]], n = np.frombuffer(r["counts"], "<i8"), r["n"]
    return inverse_frequency(held.ravel(), n)


def inverse_frequency(documents: np.ndarray, n: int) -> np.ndarray:
    """Weight by how many of n documents hold a shingle: 1 up to COMMON, down to 1 - COMMON_LOSS."""
    share = documents / max(n, 1) / COMMON
    return (1 - COMMON_LOSS * np.log(np.maximum(share, 1)) / np.log(1 / COMMON)).astype(np.float32)


def set_weights(s: Shingles, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(s.counts)) * idf[_cells(s.hashes)]).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row by sample: 32 bits naming the shingle and level that each filled row draws.

    Random variables come from tables of 65,536 quantiles, indexed by bits of one scramble of
    the shingle per sample. Rows without shingles get zeros.
    """
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, SAMPLES), np.uint32)
    if not len(filled):
        return out
    starts = offsets[filled]
    log_w = np.log(weights)
    low = np.uint64(0xFFFF)
    for k in range(SAMPLES):
        x = mix(hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        i = (x & low).astype(np.int64)
        beta = _BETA[((x >> np.uint64(16)) & low).astype(np.int64)]
        level = np.floor(log_w * _R_INVERSE[i] + beta)
        # The logarithm of the sample's key, lifted over zero so that its bits sort as it does.
        key = _LOG_C[((x >> np.uint64(32)) & low).astype(np.int64)] - _R[i] * (level - beta + 1) + np.float32(256)
        name = (x >> np.uint64(32)) ^ (level.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1))
        packed = (key.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
        out[filled, k] = (np.minimum.reduceat(packed, starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per row and band."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ mix(parts[:, :, r] + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)))
    return key


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc, key, node, n_words, n_shingles, bands, signature per row; node is null where there is no word."""
    weights = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, s in _blocks(batch):
                signature = samples(s.hashes, set_weights(s, weights.value), s.offsets)
                bands = _band_keys(signature)
                offsets = pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc")[low:high], batch.column("key")[low:high],
                    pa.array(signed(s.digests), mask=s.n_words == 0), pa.array(np.diff(s.offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(signed(bands.ravel()))),
                    pa.array([r.tobytes() for r in signature], pa.binary())],
                    ["doc", "key", "node", "n_shingles", "bands", "signature"])

    return keyed(docs).mapInArrow(
        run, "doc LONG, key LONG, node LONG, n_shingles LONG, bands ARRAY<LONG>, signature BINARY")


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest: ``near(i, others)`` tells which others i is linked with.

    Each found node is compared with those not yet found, so a dense group takes about as
    many comparisons as it has members. With ``side``, only links between 0 and 1 count.
    """
    left = np.arange(n)
    while len(left):
        queue = [int(left[0])]
        left = left[1:]
        while queue and len(left):
            i = queue.pop()
            pick = left if side is None else left[side[left] != side[i]]
            found = pick[near(i, pick)] if len(pick) else pick
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                for j in found.tolist():
                    yield i, j
                queue.extend(found.tolist())


def _tiled(rows: DataFrame, group: str, weight: str, limit: int, name: str) -> DataFrame:
    """Add low, high and side: a group over ``limit`` is cut into tiles, and every two tiles meet.

    A row of a tile goes to each pair that its tile is part of; side tells the tiles apart
    and is null within one tile.
    """
    rows = stage(rows, f"{name}-members")
    large = rows.groupBy(group).agg(F.sum(weight).alias("total")).filter(f"total > {limit}")
    large = stage(large.select(group, F.expr(f"CAST(total DIV {limit} + 1 AS INT)").alias("tiles")), f"{name}-large")
    out = rows.join(large, group, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    out = out.withColumn("own", F.pmod(F.hash("node"), F.col("tiles"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") != F.col("other"), (F.col("own") > F.col("other")).cast("int"))
    out = out.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": side})
    return out.drop("tiles", "own", "other").repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", "node")


def _linked(rows: DataFrame, group: str, link: Callable[[dict[str, list], np.ndarray | None], Iterator[tuple[int, int]]], columns: list[str]) -> DataFrame:
    """a, b: the links that ``link`` finds in each tile or pair of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in ["node", "side", *columns]}
        last = None

        def answer() -> Iterator[pa.RecordBatch]:
            nodes = held["node"]
            if len(nodes) < 2:
                return
            side = None if held["side"][0] is None else np.array(held["side"])
            found = [(nodes[i], nodes[j]) for i, j in link(held, side)]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in (group, "low", "high")), strict=True)
            values = {c: batch.column(c).to_pylist() for c in held}
            for i, at in enumerate(keys):
                if at != last:
                    yield from answer()
                    held = {c: [] for c in held}
                    last = at
                for c, v in values.items():
                    held[c].append(v[i])
        yield from answer()

    return rows.select(group, "low", "high", "node", "side", *columns).mapInArrow(run, "a LONG, b LONG")


def _alike(signatures: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return (signatures[others] == signatures[i]).sum(axis=1) >= AGREEMENT * SAMPLES


def _by_signature(held: dict[str, list], side: np.ndarray | None) -> Iterator[tuple[int, int]]:
    s = np.frombuffer(b"".join(held["signature"]), np.uint32).reshape(-1, SAMPLES)
    return _forest(len(s), lambda i, others: _alike(s, i, others), side)


def _by_similarity(held: dict[str, list], side: np.ndarray | None) -> Iterator[tuple[int, int]]:
    s = np.frombuffer(b"".join(held["signature"]), np.uint32).reshape(-1, SAMPLES)
    hashes = np.frombuffer(b"".join(held["hashes"]), np.uint64)
    weights = np.frombuffer(b"".join(held["weights"]), np.float32).astype(np.float64)
    sizes = np.array([len(h) // 8 for h in held["hashes"]])
    begins = np.append(0, np.cumsum(sizes))
    _, column = np.unique(hashes, return_inverse=True)
    total = np.add.reduceat(weights, begins[:-1])
    own = np.zeros(int(column.max()) + 1)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out = _alike(s, i, others)
        pick = others[out]
        # The lighter set can't share more than all it weighs.
        possible = np.minimum(total[pick], total[i]) >= SIMILARITY * np.maximum(total[pick], total[i]) - 1e-6
        pick, kept = pick[possible], np.flatnonzero(out)[possible]
        out[:] = False
        if len(pick):
            mine = slice(begins[i], begins[i + 1])
            own[column[mine]] = weights[mine]
            for k, j in zip(kept.tolist(), pick.tolist(), strict=True):
                at = slice(begins[j], begins[j + 1])
                both = float(np.minimum(own[column[at]], weights[at]).sum())
                out[k] = both >= SIMILARITY * (total[i] + total[j] - both) - 1e-9
            own[column[mine]] = 0
        return out

    return _forest(len(s), near, side)


def weighted_sets(docs: DataFrame, members: DataFrame, idf: np.ndarray) -> DataFrame:
    """``members`` (doc, key, node, family, n_shingles, signature) with the full sets of their texts."""
    weights = docs.sparkSession.sparkContext.broadcast(idf)
    carried = ["node", "family", "n_shingles", "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, s in _blocks(batch):
                w = set_weights(s, weights.value)
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[low:high] for c in carried), cut(s.hashes), cut(w)], [*carried, "hashes", "weights"])

    joined = keyed(docs).join(members, ["doc", "key"]).select("text", *carried)
    return joined.mapInArrow(
        run, "node LONG, family LONG, n_shingles LONG, signature BINARY, hashes BINARY, weights BINARY")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc, key, node, class_doc, class_key: the class of each row, named by its smallest row.

    ``docs`` has doc_id and text; other columns are not read. Classes are the connected
    components of links of at least ``SIMILARITY``, with equal word sequences as one. A row
    without words is alone. A null doc_id comes before all others.
    """
    idf = idf_weights(docs)
    signed_rows = stage(signatures(docs, idf), "minhash-signatures")
    nodes = stage(
        signed_rows.filter("node IS NOT NULL").groupBy("node").agg(
            F.min(F.struct("doc", "key")).alias("first"), F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"), F.first("signature").alias("signature")), "minhash-nodes")
    # Buckets of two nodes or more.
    met = nodes.select("node", F.explode("bands").alias("bucket"))
    full = stage(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "minhash-buckets")
    bucketed = stage(met.join(full, "bucket"), "minhash-met").join(nodes.select("node", "signature"), "node")
    tiles = _tiled(bucketed.withColumn("one", F.lit(1)), "bucket", "one", TILE, "minhash-bucket")
    families = stage(components(_linked(tiles, "bucket", _by_signature, ["signature"]), "minhash-family"), "minhash-families")
    # The full sets of a family's nodes, each read once from its first row's text.
    members = families.join(nodes, "node").select(
        "first.doc", "first.key", "node", F.col("root").alias("family"), "n_shingles", "signature")
    sets = _tiled(weighted_sets(docs, members, idf), "family", "n_shingles", FAMILY_TILE, "minhash-sets")
    links = _linked(sets, "family", _by_similarity, ["signature", "hashes", "weights"])
    joined = components(links, "minhash-class")
    classes = nodes.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    names = classes.groupBy("root").agg(F.min("first").alias("named"))
    classes = stage(classes.join(names, "root").select("node", "named"), "minhash-names")
    own = F.struct("doc", "key")
    return signed_rows.select("doc", "key", "node").join(classes, "node", "left").select(
        "doc", "key", F.coalesce("named", own)["doc"].alias("class_doc"), F.coalesce("named", own)["key"].alias("class_key"))


def _public(c: str):
    return F.when(F.col(c) != NO_ID, F.col(c))


def class_ids(docs: DataFrame) -> DataFrame:
    """doc_id, class_id for each row: the smallest doc_id of the row's class."""
    return near_classes(docs).select(_public("doc").alias("doc_id"), _public("class_doc").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the smallest doc_id, with the columns of ``docs``.

    Rows equal in doc_id and text count once.
    """
    first = near_classes(docs).filter("doc = class_doc AND key = class_key").select("doc", "key").distinct()
    held = Carried(docs)
    named = held.df.withColumns({
        "doc": F.coalesce(held.col("doc_id").cast("long"), F.lit(NO_ID)), "key": F.xxhash64(held.col("text"))})
    kept = named.join(stage(first, "minhash-kept"), ["doc", "key"])
    again = F.expr("row_number() OVER (PARTITION BY doc, key ORDER BY doc)")
    return kept.withColumn("again", again).filter("again = 1").select(*held.back())
