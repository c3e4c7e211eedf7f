"""Phrases that stand together more often than apart, mined by the SON partitioning scheme.

Documents are dealt into a few shards. Each shard is mined completely for phrases of two to
four words, at the support lowered to the shard's share of its language's text: a phrase that
reaches the support in the corpus reaches the lowered one in some shard. A longer phrase is
counted only where all its pairs of words are frequent in the shard. What is frequent in any
shard is a candidate; a last pass counts candidates and single words exactly, by their words.

Mining counts 64-bit hashes, so no text is shuffled; phrases that share a hash only count for
more, and the last pass settles it. Filters that tasks get are bit sets of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinspan.llm.symbols import blocks, chained, mix, prefix, span_hash, spelled_hashes, text_buffers
from twinspan.operators.store import stage

# Fixed values of the task.
LONGEST = 4
SUPPORT = 30
SHOWN = 2000
UNKNOWN = "und"

#: Logical shards, a power of two; each is mined by as many tasks as hold rows of it.
SHARD_BITS = 2
SHARDS = 1 << SHARD_BITS
#: Bits of the filters of frequent pairs and of candidates; 4 MB each for any corpus.
FILTER_BITS = 25
#: Words that a task counts together before it hands the counts on.
FLUSH = 150_000
#: Bytes of text that a task is handed at a time; a longer text is alone.
BATCH = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte, piece and row of each word of a block of lower-cased texts."""
    inside = ~_GAP[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = inside, inside
    before[offsets], after[offsets] = False, False
    starts, ends = np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[1:]) + 1
    breaks = np.cumsum(_BREAK[data])
    row = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, (breaks[starts] if len(starts) else starts) + row, row


def _reach(piece: np.ndarray, size: int) -> np.ndarray:
    """True where a phrase of ``size`` words may begin."""
    n = len(piece)
    out = np.zeros(n, bool)
    if n >= size:
        out[: n - size + 1] = piece[size - 1 :] == piece[: n - size + 1]
    return out


@dataclass
class _Texts:
    """Words of several blocks: hash, piece, and the row's language, shard and support; words themselves if asked for."""

    hashes: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    shard: np.ndarray
    least: np.ndarray
    names: list[str]
    words: pa.ChunkedArray | None


def _collected(batches: Iterator[pa.RecordBatch], spelled: bool) -> Iterator[_Texts]:
    """Words of the batches' rows (lang, shard, least, text), about ``FLUSH`` at a time."""
    parts, names, hashed, total, last = [], {}, np.zeros(0, np.uint64), 0, 0

    def together() -> _Texts:
        columns = [np.concatenate(c) for c in list(zip(*parts, strict=True))[:5]]
        return _Texts(*columns, list(names), pa.chunked_array([p[5] for p in parts]) if spelled else None)

    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        shards, least = (batch.column(c).to_numpy().astype(t) for c, t in (("shard", np.int8), ("least", np.int32)))
        code = np.array([names.setdefault(x, len(names)) for x in langs.dictionary.to_pylist()], np.int32)[langs.indices.to_numpy()]
        hashed = np.concatenate([hashed, _name_hashes(list(names)[len(hashed) :])])
        for low, high in blocks(offsets):
            part = _LOWER[data[offsets[low] : offsets[high]]]
            starts, ends, piece, row = _words(part, offsets[low : high + 1] - offsets[low])
            if not len(starts):
                continue
            # The language is part of a word, so phrases of different languages differ.
            lang = code[low:high][row]
            hashes = mix(spelled_hashes(part, starts, ends) ^ hashed[lang])
            words = None
            if spelled:
                at = np.append(0, np.cumsum(ends - starts))
                words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(part[~_GAP[part]]))
            parts.append((hashes, piece + last, lang, shards[low:high][row], least[low:high][row], words))
            last = int(parts[-1][1][-1]) + 1
            total += len(starts)
            if total >= FLUSH:
                yield together()
                parts, total, last = [], 0, 0
    if parts:
        yield together()


def _name_hashes(names: list[str]) -> np.ndarray:
    out = np.zeros(len(names), np.uint64)
    for i, name in enumerate(names):
        value = np.frombuffer(name.encode(), np.uint8)
        out[i] = span_hash(prefix(value), np.array([0]), np.array([len(value)]))[0]
    return out


def _cell(keys: np.ndarray, shard: np.ndarray | int) -> np.ndarray:
    """Bit of a key in a filter; a shard has its own."""
    return (keys ^ (np.asarray(shard).astype(np.int64) * 40503).astype(np.uint64)) & np.uint64((1 << FILTER_BITS) - 1)


def _passes(filter_: np.ndarray, keys: np.ndarray, shard: np.ndarray | int = 0) -> np.ndarray:
    cell = _cell(keys, shard)
    return (filter_[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bit_filter(keys: DataFrame) -> np.ndarray:
    """The bits of all ``key`` LONG, each taken in the part of its ``shard`` LONG.

    Bits are put together by the tasks; the driver gets the filled words of a set of fixed size.
    """
    cell = F.col("key").bitwiseXOR(F.col("shard") * 40503).bitwiseAND((1 << FILTER_BITS) - 1)
    words = keys.select(cell.alias("cell")).select(
        F.shiftright("cell", 5).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(cell & 31 AS INT))").alias("bit"))
    filled = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def _phrase_keys(words: np.ndarray, size: int) -> np.ndarray:
    """Non-negative keys of ``size`` neighbouring words, with room for a shard's number."""
    return chained(words, size) >> np.uint64(SHARD_BITS + 1)


def _counted(texts: _Texts, sizes: tuple[int, ...], allowed) -> Iterator[pa.RecordBatch]:
    """key, n, least of the phrases of the given sizes whose places ``allowed`` lets pass."""
    for size in sizes:
        at = np.flatnonzero(_reach(texts.piece, size) & allowed(size))
        if not len(at):
            continue
        keys = (_phrase_keys(texts.hashes, size)[at] << np.uint64(SHARD_BITS)) | texts.shard[at].astype(np.uint64)
        keys, first, n = np.unique(keys, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(texts.least[at[first]])], ["key", "n", "least"])


def _frequent(docs: DataFrame, sizes: tuple[int, ...], pairs, name: str) -> DataFrame:
    """shard, key of the phrases that reach their shard's support; ``pairs`` filters longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _collected(batches, False):
            n = len(texts.hashes)
            if pairs is None:
                yield from _counted(texts, sizes, lambda size: np.ones(n, bool))
                continue
            pair = np.zeros(n, bool)
            if n > 1:
                pair[:-1] = _passes(pairs.value, _phrase_keys(texts.hashes, 2), texts.shard[:-1])

            def allowed(size, pair=pair):
                out = pair.copy()
                for k in range(1, size - 1):
                    out[:-k] &= pair[k:]
                return out

            yield from _counted(texts, sizes, allowed)

    counts = docs.mapInArrow(run, "key LONG, n INT, least INT").groupBy("key").agg(F.sum("n").alias("n"), F.max("least").alias("least"))
    frequent = counts.filter("n >= least").select(F.col("key").bitwiseAND(SHARDS - 1).alias("shard"), F.shiftright("key", SHARD_BITS).alias("key"))
    return stage(frequent, f"collocations-{name}")


def _phrase_counts(docs: DataFrame, candidates) -> DataFrame:
    """lang, size, phrase, f: exact counts of all words and of phrases that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _collected(batches, True):
            named = texts.words.combine_chunks().dictionary_encode()
            spelled, ids = named.dictionary.cast(pa.string()), named.indices.to_numpy().astype(np.int64)
            names = pa.array(texts.names, pa.string())
            # A word's number holds its language.
            codes, word = np.unique(texts.lang.astype(np.int64) * len(spelled) + ids, return_inverse=True)
            lang_of, id_of = codes // len(spelled), codes % len(spelled)

            def batch(lang, size, phrase, n):
                return pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lang)), pa.array(np.full(len(n), size, np.int32)), phrase, pa.array(n.astype(np.int64))],
                    ["lang", "size", "phrase", "f"])

            yield batch(lang_of, 1, spelled.take(pa.array(id_of)), np.bincount(word))
            for size in range(2, LONGEST + 1):
                at = np.flatnonzero(_reach(texts.piece, size))
                at = at[_passes(candidates.value, _phrase_keys(texts.hashes, size)[at])] if len(at) else at
                if not len(at):
                    continue
                # Numbers of phrases from numbers of their beginnings, exact at each step.
                number = word[at]
                for k in range(1, size):
                    _, first, number = np.unique(number * len(codes) + word[at + k], return_index=True, return_inverse=True)
                here = at[first]
                parts = [spelled.take(pa.array(ids[here + k])) for k in range(size)]
                yield batch(texts.lang[here], size, pc.binary_join_element_wise(*parts, " "), np.bincount(number))

    counts = docs.mapInArrow(run, "lang STRING, size INT, phrase STRING, f LONG")
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def _shards(docs: DataFrame, support: int) -> DataFrame:
    """lang, shard, least, text; a null language is ``UNKNOWN``. What stands in a row decides its shard.

    ``least`` is the support lowered to the shard's share of the language's bytes, rounded up.
    Shares add up to one, so a phrase that misses it in every shard misses the support altogether.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.pmod(F.xxhash64("doc_id", "lang"), F.lit(SHARDS)).cast("int").alias("shard"), "text")
    sizes = rows.groupBy("lang", "shard").agg(F.sum(F.octet_length("text").cast("long")).alias("held"))
    total = sizes.groupBy("lang").agg(F.sum("held").alias("total"))
    number = lambda c: F.col(c).cast("decimal(20, 0)")
    share = F.ceil(F.lit(support).cast("decimal(10, 0)") * number("held") / number("total")).cast("int")
    weights = sizes.join(total, "lang").filter("held > 0").select("lang", "shard", F.greatest(share, F.lit(1)).alias("least"))
    # Rows of languages and shards without a byte have no words.
    return rows.join(stage(weights, "collocations-support"), ["lang", "shard"])


def _parts() -> Column:
    """The cuts of ``phrase`` in ``size`` words: how many words come first, the first part, the rest."""
    words = F.split("phrase", " ")
    cut = lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"),
        F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("rest"))
    return F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))


def _inner(words: Column, size: Column) -> Column:
    """All contiguous phrases of two words or more that are shorter than the whole."""
    lengths = F.sequence(F.lit(2), size - 1)
    at = lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.array_join(F.slice(words, s, m), " "))
    return F.explode(F.array_distinct(F.flatten(F.transform(lengths, at))))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand their tasks batches of about ``BATCH`` bytes, whatever the number of rows.

    Ten thousand texts at once stand in the memory of the executor and of each of its workers.
    """
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def collocations(docs: DataFrame, support: int = SUPPORT, shown: int = SHOWN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Texts are lower-cased (A to Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words
    ``[^\\x20\\x09]+``. A phrase of two to four words that stands ``a >= support`` times is cut in
    two where floor(2000000 a / (l + r)) is least, l and r being the counts of its parts (ties:
    the first cut). Phrases inside a longer one that has at least 80 % of their count go. n is
    the number of the language's words.

    A null text is empty, a null ``lang`` is ``und``; repeated rows count as often as they stand;
    phrases that tie in score rank by count, then by their bytes. An empty table gives no rows.
    ``doc_id`` only deals rows to shards and may be null or repeated. Further columns are not
    read. Tasks count ``FLUSH`` words at a time, whatever the number and length of texts; one
    text is taken whole.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        sharded = _shards(docs, support)
        pairs = _frequent(sharded, (2,), None, "pairs")
        longer = _frequent(sharded, tuple(range(3, LONGEST + 1)), spark.sparkContext.broadcast(bit_filter(pairs)), "longer")
        union = pairs.unionAll(longer).select(F.lit(0).cast("long").alias("shard"), "key")
        counts = _phrase_counts(sharded, spark.sparkContext.broadcast(bit_filter(union)))
        counts = stage(counts, "collocations-counts")
    n = counts.filter("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    counts = counts.filter(F.col("f") >= support)
    found = stage(counts.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a")), "collocations-found")
    return _ranked(found, counts, n, shown)


def _ranked(found: DataFrame, counts: DataFrame, n: DataFrame, shown: int) -> DataFrame:
    cuts = stage(found.select("lang", "phrase", "a", _parts().alias("cut")).select("lang", "phrase", "a", "cut.*"), "collocations-cuts")
    part = lambda column, count: counts.select("lang", F.col("phrase").alias(column), F.col("f").alias(count)).hint("merge")
    halves = stage(cuts.join(part("first", "l"), ["lang", "first"]), "collocations-first").join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + r) AS LONG)")
    best = halves.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = found.filter("size > 2").select("lang", F.col("a").alias("f"), _inner(F.split("phrase", " "), F.col("size")).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = best.join(longest, ["lang", "phrase"], "left").filter("longer IS NULL OR CAST(100 AS DECIMAL(3, 0)) * longer < CAST(80 AS DECIMAL(2, 0)) * a")
    held = held.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The best of each part first, so that a language never meets whole.
    leading = held.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= shown)
    ranked = leading.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= shown)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
