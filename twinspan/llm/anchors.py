"""Where texts may share long passages: content-chosen anchors, and the regions they stand for.

A window of L symbols (words or bytes) names one of its own short grams, the one with the
least rolling hash, as its anchor. Equal windows name equal anchors at equal places, so two
texts that share a window share an anchor, and only texts that meet at an anchor need to be
compared. The neighbouring windows that name the same anchor form a region; equal regions are
told by a 128-bit cryptographic digest of their content before any content moves.

``find_repeats`` gives, for documents of any number:

* regions that stand in the corpus more than once as they are: no comparison needed;
* the distinct regions that share an anchor and the half of a window beside it with a different
  region, with their content, for a solver that compares them window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.llm.symbols import (
    BLOCK, BYTE_VALUES, SPACES, blocks, chained, mix, quick_spans, quick_sums, ranges, signed, sliding_min, spelled_hashes, text_buffers,
    word_spans)
from twinspan.operators.store import release, stage, staged

#: A packed anchor choice: the high bits of the gram's hash over its place.
_PLACE_BITS = 28
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


@dataclass
class Symbols:
    """The symbols of a block of texts."""

    #: A 64-bit value each, and where each text's symbols begin.
    values: np.ndarray
    offsets: np.ndarray
    #: The bytes that stand for them: words with one space between, or the text itself.
    data: np.ndarray
    #: Where each symbol begins and ends in ``data``; None where each is one byte.
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def spelled(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes [from, to) of the symbols [low, high); equal where these are."""
        return (low, high) if self.starts is None else (self.starts[low], self.ends[high - 1])


@dataclass(frozen=True)
class Unit:
    """What a symbol is, the length of a shared passage, and the length of an anchor."""

    words: bool
    window: int
    gram: int

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> Symbols:
        if not self.words:
            return Symbols(BYTE_VALUES[data], offsets, data)
        starts, ends, rows = word_spans(data, offsets)
        space = SPACES[data]
        # Of each run of spaces the first stays.
        kept = ~space
        kept[1:] |= ~space[:-1]
        at = np.cumsum(kept) - 1
        begin = at[starts] if len(starts) else starts
        return Symbols(spelled_hashes(data, starts, ends), rows, np.where(space, np.uint8(0x20), data)[kept], begin, begin + ends - starts)

    def grams(self, values: np.ndarray) -> np.ndarray:
        return chained(values, self.gram)

    def packed(self, grams: np.ndarray) -> np.ndarray:
        """What the least of is a window's anchor: the gram's hash, then its place; the first of equal grams."""
        return (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)

    def least(self, grams: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The place of the anchor in each row of places."""
        return (self.packed(grams)[places].min(axis=1) & _PLACE).astype(np.int64)


def regions(values: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Regions of a block: row, first window in the row, number of windows, anchor hash."""
    return sided(values, offsets, unit)[:4]


def sided(values: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """``regions``, with the hashes of their ``halves``."""
    length, gram = unit.window, unit.gram
    n = len(values)
    sizes = np.diff(offsets)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, *[none.view(np.uint64)] * 3
    grams = unit.grams(values)
    choice = sliding_min(unit.packed(grams), length - gram + 1)
    rows = np.flatnonzero(sizes >= length)
    counts = sizes[rows] - length + 1
    windows = ranges(offsets[rows], counts)
    row_of = np.repeat(rows, counts)
    anchor = (choice[windows] & _PLACE).astype(np.int64)
    # A row's last window and the next row's first never share an anchor, so a change is enough.
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    n_windows = np.diff(np.append(first, len(anchor)))
    start, at, row = windows[first], anchor[first], row_of[first]
    return row, start - offsets[row], n_windows, grams[at], *halves(values, start, start + n_windows + length - 1, at, grams[at], unit)


def halves(values: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, anchor: np.ndarray, unit: Unit) -> list[np.ndarray]:
    """A hash of anchor and half window before the anchor, and of anchor and half window behind it; 0 where regions end before.

    A window holds its anchor, so at least half of what else it holds lies on one side of it.
    Different regions share a window only if they share that half. Equal hashes of different
    halves only keep a region more.
    """
    half, sums, out = (unit.window - unit.gram) // 2, quick_sums(values), []
    for side, begin in enumerate((at - half, at + unit.gram)):
        inside = np.flatnonzero((begin >= low) & (begin + half <= high))
        name = np.zeros(len(at), np.uint64)
        name[inside] = mix(quick_spans(sums, begin[inside], begin[inside] + half) ^ anchor[inside] + np.uint64(side)) | np.uint64(1)
        out.append(name)
    return out


def pieces(values: np.ndarray, offsets: np.ndarray, unit: Unit) -> Iterator[tuple[np.ndarray, ...]]:
    """Regions of a block, a very long row in pieces that overlap by all but one symbol of a window."""
    most = 8 * BLOCK
    if len(values) <= most:
        yield sided(values, offsets, unit)
        return
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for low in range(a, max(b - unit.window + 1, a + 1), most):
            high = min(b, low + most + unit.window - 1)
            found = sided(values[low:high], np.array([0, high - low]), unit)
            yield found[0] + row, found[1] + (low - a), *found[2:]


def digests(symbols: Symbols, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Two LONGs of 128 bits each that tell the contents of symbol ranges apart."""
    held = memoryview(symbols.data.tobytes())
    found = b"".join(
        hashlib.blake2b(held[a:b], digest_size=16).digest() for a, b in zip(*(x.tolist() for x in symbols.spelled(low, high)), strict=True))
    return np.frombuffer(found, np.int64).reshape(-1, 2)


#: The least LONG: a null doc_id comes before all others.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc, key, text: the id and a hash of the text name a row.

    Rows equal in both are told apart by nothing and get the same result, so repeated ids and
    repeated rows need no numbering.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), "text")


def occurrences(docs: DataFrame, unit: Unit) -> DataFrame:
    """doc, key, start, n_windows, anchor, before, behind (``halves``), digest, digest2: one row per region of each text."""
    names = ["doc", "key", "start", "n_windows", "anchor", "before", "behind", "digest", "digest2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = (batch.column(c).to_numpy() for c in ("doc", "key"))
            data, offsets = text_buffers(batch.column("text"))
            for low, high in blocks(offsets):
                symbols = unit.symbols(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for row, start, n, *hashes in pieces(symbols.values, symbols.offsets, unit):
                    at = symbols.offsets[row] + start
                    digest = digests(symbols, at, at + n + unit.window - 1)
                    columns = (doc[low:high][row], key[low:high][row], start.astype(np.int32), n.astype(np.int32), *map(signed, hashes))
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, columns), *(pa.array(np.ascontiguousarray(digest[:, k])) for k in (0, 1))], names)

    return keyed(docs).mapInArrow(run, "doc LONG, key LONG, start INT, n_windows INT, anchor LONG, before LONG, behind LONG, digest LONG, digest2 LONG")


#: What names a distinct region.
REGION = ["anchor", "digest", "digest2"]


@dataclass
class Repeats:
    #: doc, key, start, n_windows, first_doc: the occurrences of each region that stands in the
    #: corpus more than once, with the smallest document that holds it.
    copies: DataFrame
    #: REGION, doc, key, start, n_windows, n: one row per distinct region that has half a window in
    #: common with a different region, with one of its places in its smallest document.
    mixed: DataFrame
    #: REGION, doc, key, start: all places of those regions in their smallest documents.
    places: DataFrame


def find_repeats(docs: DataFrame, unit: Unit, name: str) -> Repeats:
    """Regions that may repeat among rows with ``doc_id`` and ``text``.

    Every table that a hot anchor meets in a join is written first, so that both sides of the
    join are plain scans and adaptive execution can split the anchor's rows. It splits by the
    tasks that rows come from: rows that an earlier join has put together, which as a file may
    be small enough for a single task, are dealt out before they meet again.
    """
    before = staged()
    found = stage(occurrences(docs, unit), f"{name}-regions")
    apart = (F.min("digest") != F.max("digest")) | (F.min("digest2") != F.max("digest2"))
    met = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), apart.alias("differ"), F.min("doc").alias("first_doc"))
    met = stage(met.filter("n > 1").drop("n"), f"{name}-anchors")
    # Merge joins: one that turns into a broadcast after its shuffle keeps a hot key in one task.
    read = [t for t in staged() if t not in before]
    repeated = stage(found.join(met.hint("merge"), "anchor"), f"{name}-repeated")
    # Nothing reads all regions from here on.
    release(docs.sparkSession, read)
    differ = repeated.filter("differ").drop("first_doc", "differ")
    distinct = stage(differ.groupBy(*REGION).agg(
        F.min(F.struct("doc", "key", "start")).alias("first"), F.count(F.lit(1)).alias("n"),
        *[F.first(c).alias(c) for c in ("n_windows", "before", "behind")]), f"{name}-distinct")
    # Only regions that share the half of a window may share a window.
    sides = distinct.withColumn("half", F.explode(F.array("before", "behind"))).filter("half <> 0").drop("before", "behind")
    shared = stage(sides.groupBy("half").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("half"), f"{name}-halves")
    mixed = sides.join(shared.hint("merge"), "half", "left_semi").groupBy(*REGION).agg(
        *[F.first(c).alias(c) for c in ("first", "n_windows", "n")])
    deal = lambda df: df.withColumn("_at", F.xxhash64("doc", "key", "start")).repartition("_at").drop("_at")
    first = distinct.select(*REGION, F.col("first.doc").alias("first_doc"), "n")
    known = stage(deal(differ.drop("before", "behind")).join(first.hint("merge"), REGION), f"{name}-known")
    out = ["doc", "key", "start", "n_windows", "first_doc"]
    copies = repeated.filter("NOT differ").select(*out).unionAll(known.filter("n > 1").select(*out))
    places = deal(known.filter("doc = first_doc").select(*REGION, "doc", "key", "start"))
    return Repeats(copies, mixed.select(*REGION, "first.*", "n_windows", "n"), places)


def region_contents(docs: DataFrame, mixed: DataFrame, unit: Unit) -> DataFrame:
    """REGION, doc, n and ``content`` BINARY: words with one space between, or the bytes themselves.

    A row's regions are as many as its text has windows at most, and are gathered by row.
    """
    carried = [*REGION, "doc", "n"]
    wanted = mixed.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "n_windows", *carried)).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            asked, items = batch.column("wanted").offsets.to_numpy(), batch.column("wanted").values
            for low, high in blocks(offsets):
                symbols = unit.symbols(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                begin = np.repeat(symbols.offsets[:-1], np.diff(asked[low : high + 1]))
                got = items.slice(asked[low], asked[high] - asked[low])
                start, n_windows = (got.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                if not len(start):
                    continue
                a, b = symbols.spelled(begin + start, begin + start + n_windows + unit.window - 1)
                content = symbols.data[ranges(a, b - a)]
                ends = np.append(0, np.cumsum(b - a))
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(content)])
                yield pa.RecordBatch.from_arrays(
                    [*(got.field(i) for i in range(2, 2 + len(carried))), binary.cast(pa.binary())], [*carried, "content"])

    # Rows that repeat give their regions again, which stands for nothing new.
    return keyed(docs).join(wanted, ["doc", "key"]).select("text", "wanted").mapInArrow(run, "anchor LONG, digest LONG, digest2 LONG, doc LONG, n LONG, content BINARY")


#: Distinct regions of one anchor that are compared in one go.
SHARD = 2048
#: Windows whose digests are handed on together, about.
WINDOWS = 100_000


@dataclass(frozen=True)
class Region:
    digest: int
    digest2: int
    doc: int
    n: int
    content: bytes


#: From reference regions, in order of doc, to a function that yields, for a list of probes,
#: (index of probe, first symbol, end symbol) of what stands elsewhere.
Solver = Callable[[list[Region]], Callable[[list[Region]], Iterator[tuple[int, int, int]]]]


def window_copies(contents: DataFrame, length: int, name: str) -> DataFrame:
    """REGION, low, high: the bytes of regions that a window of ``length`` bytes covers which stands elsewhere as it is.

    Windows are told by a 128-bit cryptographic digest as regions are, and each moves by its own: the work
    grows with the number of regions, however many share an anchor.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [*REGION, "n"]
        for batch in batches:
            texts = batch.column("content").to_pylist()
            counts = np.array([max(len(x) - length + 1, 0) for x in texts], np.int64)
            most = np.cumsum(counts) // WINDOWS
            for g in np.unique(most):
                rows = np.flatnonzero(most == g)
                found = b"".join(
                    hashlib.blake2b(held[a : a + length], digest_size=16).digest()
                    for held, n in ((memoryview(texts[k]), counts[k]) for k in rows) for a in range(n))
                window = np.frombuffer(found, np.int64).reshape(-1, 2)
                row = pa.array(np.repeat(rows, counts[rows]))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).take(row) for c in columns), pa.array(ranges(np.zeros(len(rows), np.int64), counts[rows]), pa.int32()),
                    *(pa.array(np.ascontiguousarray(window[:, k])) for k in (0, 1))], [*columns, "low", "window", "window2"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lows")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy().astype(np.int64)
            row, low, high = merged(row, at, at + length)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(row)) for c in REGION), pa.array(low, pa.int32()), pa.array(high, pa.int32())], [*REGION, "low", "high"])

    kind = "anchor LONG, digest LONG, digest2 LONG"
    windows = stage(contents.select(*REGION, "n", "content").mapInArrow(cut, f"{kind}, n LONG, low INT, window LONG, window2 LONG"), f"{name}-windows")
    twice = windows.groupBy("window", "window2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    # Regions that stand in the corpus again as they are need no answer.
    asked = windows.filter("n = 1").join(stage(twice, f"{name}-twice").hint("merge"), ["window", "window2"])
    return asked.groupBy(*REGION).agg(F.sort_array(F.collect_list("low")).alias("lows")).mapInArrow(runs, f"{kind}, low INT, high INT")


def solve(contents: DataFrame, places: DataFrame, solver: Solver, batch_bytes: int, name: str, window: int | None = None) -> DataFrame:
    """doc, key, start, end: the symbols of windows that ``solver`` finds elsewhere, at all ``places`` of their regions.

    Regions go to tasks by anchor. An anchor with more than ``SHARD`` regions is split: each
    part is a reference shard, and all the anchor's regions are streamed past it, so a task
    holds one shard and a few probes. Small anchors are solved several at once.

    The shards' work grows with the square of an anchor's regions. Where symbols are bytes and ``window`` tells how
    many a window has, the regions of such an anchor go to ``window_copies`` instead.
    """
    contents = stage(contents, f"{name}-contents")
    sizes = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter(f"m > {SHARD}")
    hot = stage(sizes.select("anchor", F.expr(f"CAST(m DIV {SHARD} + 1 AS INT)").alias("shards")), f"{name}-hot")
    copies = None
    if window is not None:
        copies = window_copies(contents.join(hot, "anchor", "left_semi"), window, name)
        contents = contents.join(hot, "anchor", "left_anti")
    shards = F.coalesce("shards", F.lit(1))
    dealt = contents.join(hot, "anchor", "left").withColumn("own", F.pmod(F.hash("digest"), shards))
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    columns = ["anchor", "shard", "probe", "digest", "digest2", "doc", "n", "content"]
    dealt = dealt.withColumn("probe", F.col("own") != F.col("shard")).select(*columns)
    dealt = dealt.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "probe", "doc")

    def answers(anchors: list[int], references: list[Region], probes: list[Region]) -> Iterator[pa.RecordBatch]:
        found = [(anchors[i], probes[i].digest, probes[i].digest2, a, b)
                 for i, a, b in solver(sorted(references, key=lambda r: r.doc))(probes)]
        if found:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*REGION, "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, references, probes, size, last = [], [], [], 0, None
        for batch in batches:
            for anchor, shard, only_probe, *rest in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                region = Region(*rest)
                # Shards of one anchor have the same probes and must not meet.
                if last and (anchor, shard) != last and (size >= batch_bytes or anchor == last[0]):
                    yield from answers(anchors, references, probes)
                    anchors, references, probes, size = [], [], [], 0
                elif only_probe and len(probes) >= 2 * SHARD:
                    yield from answers(anchors, references, probes)
                    anchors, probes = [], []
                if not only_probe:
                    references.append(region)
                anchors.append(anchor)
                probes.append(region)
                size += len(region.content)
                last = (anchor, shard)
        if probes:
            yield from answers(anchors, references, probes)

    found = dealt.mapInArrow(run, "anchor LONG, digest LONG, digest2 LONG, low INT, high INT")
    found = stage(found if copies is None else found.unionByName(copies), f"{name}-found")
    spread = places.join(found.hint("merge"), REGION)
    return spread.select("doc", "key", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end"))


def covered(found: DataFrame) -> DataFrame:
    """doc, key, spans: the sorted disjoint union of each document's [start, end) ranges, bounded by its length."""
    lists = found.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end = span_rows(batch.column("spans"))
            order = np.lexsort((start, row))
            row, start, end = merged(row[order], start[order], end[order])
            counts = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("key"), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)],
                ["doc", "key", "spans"])

    return lists.mapInArrow(run, "doc LONG, key LONG, spans ARRAY<STRUCT<start: INT, end: INT>>")


def span_rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each span of a column of spans; a null list has none."""
    sizes = np.diff(lists.offsets.to_numpy())
    items = lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum()))
    start, end = (items.field(k).to_numpy().astype(np.int64) for k in (0, 1))
    return np.repeat(np.arange(len(lists)), sizes), start, end


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges that are sorted by row and start; touching ones become one."""
    if not len(row):
        return row, start, end
    width = int(end.max()) + 1
    reach = np.maximum.accumulate(row * width + end)
    new = np.append(True, (row[1:] * width + start[1:] > reach[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    return row[first], start[first], reach[np.append(first[1:], len(row)) - 1] - row[first] * width


def mask(n: int, begins: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True for each of n symbols that a span covers; spans of a row are disjoint."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begins[row] + start, 1)
    np.add.at(change, begins[row] + end, -1)
    return np.cumsum(change[:-1]) > 0
