"""Periodic runs of words, by internal pattern matching over dyadic blocks.

A run with smallest period q repeats at least four times, so it holds, within its first words,
an aligned block of L words with L/2 <= q < L (L a power of two), and that block stands again
exactly q words further on or back: a nearer occurrence would make the period shorter. So for
every aligned block of L words its next and its last occurrence are asked of a wavelet tree over
the suffix array (range successor: the least place above, the greatest below, within the block's
interval). A block's occurrences at distance d < L overlap, and overlapping occurrences are an
arithmetic progression: d is a candidate period of the words they cover. What candidates of one
period cover is put together, extended word by word to both sides, and kept where it repeats
often enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.llm.symbols import SPACES, blocks, ranges, text_buffers, word_spans

#: How often a run repeats its period at least, and its least length in words.
REPEATS = 4
LEAST = 6


class WaveletMatrix:
    """Numbers of ``bits`` bits in a fixed order, one bit level at a time, most significant first.

    Each level keeps its bits packed, with the number of zeros before each 64-bit word.
    """

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.levels = len(values), []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit) & 1
            zero = ones == 0
            packed = np.packbits(zero, bitorder="little")
            words = np.zeros((self.n >> 6) + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((bit, words, before, int(before[-1])))
            values = np.concatenate([values[zero], values[~zero]])

    @staticmethod
    def _zeros(level: tuple, at: np.ndarray) -> np.ndarray:
        """How many of a level's first ``at`` bits are zero."""
        _, words, before, _ = level
        word = at >> 6
        part = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return before[word] + np.bitwise_count(part)

    def count_below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers at the places [low, high) are less than ``value``."""
        found = np.zeros(len(low), np.int64)
        for level in self.levels:
            a, b = self._zeros(level, low), self._zeros(level, high)
            one = (value >> level[0]) & 1 == 1
            found += np.where(one, b - a, 0)
            low, high = np.where(one, low - a + level[3], a), np.where(one, high - b + level[3], b)
        return found

    def ranked(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with ``k`` smaller ones among those at the places [low, high)."""
        found = np.zeros(len(low), np.int64)
        for level in self.levels:
            a, b = self._zeros(level, low), self._zeros(level, high)
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            found |= np.where(one, 1 << level[0], 0)
            low, high = np.where(one, low - a + level[3], a), np.where(one, high - b + level[3], b)
        return found

    def neighbours(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest number below ``value`` and the least above it at the places [low, high); -1 if none.

        The numbers are distinct and ``value`` is among them.
        """
        smaller = self.count_below(low, high, value)
        above, below = smaller + 1 < high - low, smaller > 0
        last, following = np.full(len(low), -1), np.full(len(low), -1)
        last[below] = self.ranked(low[below], high[below], smaller[below] - 1)
        following[above] = self.ranked(low[above], high[above], smaller[above] + 1)
        return last, following


@dataclass
class Blocks:
    """Aligned blocks that stand in their text again: length, place, and interval of the suffix array."""

    length: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray


def suffixes_and_blocks(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Blocks]:
    """The suffix array of several texts, and their repeated aligned blocks.

    ``symbols`` are non-negative, and no two texts share one, so whatever is equal is of one
    text. Ranks double their reach; after the step that tells ``L`` symbols apart, the places
    of one rank are the interval of that block. Only places that are still alike are sorted
    again, and a suffix that ends within L symbols is alike to none.
    """
    n = len(symbols)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    begins = np.repeat(offsets[:-1], np.diff(offsets))
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n, np.int64)
    new = np.append(True, symbols[order][1:] != symbols[order][:-1])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    found: list[tuple[np.ndarray, ...]] = []
    # Slots of the order whose places are alike so far; groups stay whole.
    alike = np.flatnonzero(~(new & np.append(new[1:], True)))
    reach = 1
    while len(alike):
        at = order[alike]
        group = rank[at]
        ahead = at + reach
        follow = np.where(ahead < ends[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        # Suffixes that end here: each its own, in order of place, before all longer ones.
        follow = np.where(follow == 0, at - n, follow)
        by = np.lexsort((follow, group))
        at, group, follow = at[by], group[by], follow[by]
        order[alike] = at
        new = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        rank[at] = alike[first][which]
        size = np.diff(np.append(first, len(at)))[which]
        reach *= 2
        again = size > 1
        alike, at, size = alike[again], at[again], size[again]
        aligned = (at - begins[at]) % reach == 0
        place, low = at[aligned], rank[at[aligned]]
        found.append((np.full(len(place), reach), place, low, low + size[aligned]))
    if not found:
        return order, Blocks(*[np.zeros(0, np.int64)] * 4)
    return order, Blocks(*[np.concatenate(c) for c in zip(*found, strict=True)])


def candidates(order: np.ndarray, found: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Period, start and end: at the places [start, end) each symbol equals the one a period further on."""
    # Suffixes outside all blocks' intervals are never asked for.
    change = np.zeros(len(order) + 1, np.int64)
    np.add.at(change, found.low, 1)
    np.add.at(change, found.high, -1)
    asked = np.cumsum(change[:-1]) > 0
    slot = np.append(0, np.cumsum(asked))
    tree = WaveletMatrix(order[asked], max(int(len(order) - 1).bit_length(), 1))
    last, following = tree.neighbours(slot[found.low], slot[found.high], found.place)
    out = []
    for start, period, known in ((found.place, following - found.place, following >= 0), (last, found.place - last, last >= 0)):
        known = known & (2 * period >= found.length) & (period < found.length)
        out.append((period[known], start[known], start[known] + found.length[known]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def runs(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start in the row, length and period of each run, by row, start and period."""
    none = np.zeros(0, np.int64)
    if len(symbols) < 2:
        return none, none, none, none
    period, start, end = candidates(*suffixes_and_blocks(symbols, offsets))
    if not len(period):
        return none, none, none, none
    by = np.lexsort((start, period))
    period, start, end = period[by], start[by], end[by]
    # Spans of one period that touch are one run; a run's blocks lie side by side.
    width = len(symbols) + 1
    reach = np.maximum.accumulate(period * width + end)
    new = np.flatnonzero(np.append(True, period[1:] * width + start[1:] > reach[:-1]))
    period, start, end = period[new], start[new], reach[np.append(new[1:], len(reach)) - 1] - period[new] * width
    row = np.searchsorted(offsets, start, side="right") - 1
    low, high = offsets[row], offsets[row + 1]
    start, end = _extended(symbols, start, end, period, low, high)
    length = end + period - start
    kept = length >= np.maximum(LEAST, REPEATS * period)
    row, start, length, period = row[kept], (start - low)[kept], length[kept], period[kept]
    # Spans that met only when extended are the same run twice.
    found = np.unique(np.stack([row, start, period, length], axis=1), axis=0)
    return found[:, 0], found[:, 1], found[:, 3], found[:, 2]


def _extended(symbols, start, end, period, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Spans grown while the symbols a period apart are equal, all spans one step at a time."""
    start, end = start.copy(), end.copy()
    open_ = np.arange(len(start))
    while len(open_):
        at = start[open_] - 1
        grows = at >= low[open_]
        grows[grows] = symbols[at[grows]] == symbols[at[grows] + period[open_][grows]]
        open_ = open_[grows]
        start[open_] -= 1
    open_ = np.arange(len(start))
    while len(open_):
        at = end[open_]
        grows = at + period[open_] < high[open_]
        grows[grows] = symbols[at[grows]] == symbols[at[grows] + period[open_][grows]]
        open_ = open_[grows]
        end[open_] += 1
    return start, end


def _symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A number per word: equal for equal words of one text, different between texts."""
    offsets = np.append(0, np.cumsum(ends - starts))
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~SPACES[data]])])
    named = words.dictionary_encode()
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    return row * max(len(named.dictionary), 1) + named.indices.to_numpy().astype(np.int64)


def kept_words(n: int, rows: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for each word that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rows[row] + start + period, 1)
    np.add.at(change, rows[row] + start + length, -1)
    return np.cumsum(change[:-1]) == 0


RUNS = "runs ARRAY<STRUCT<start: LONG, length: LONG, period: LONG>>, n_words LONG, collapsed STRING"


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with runs, n_words LONG and collapsed STRING.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period q and a
    length of at least 4q and 6 that no neighbouring word extends; runs come by start, then period.
    ``collapsed`` has the words that no run holds after its first q words, joined by one space.

    Null text has no words: no runs, an empty collapsed text. Rows are taken each for itself, so
    ties, repeated rows and null ids need no rule; columns of the names that are added are
    replaced, all others pass unchanged; an empty table stays empty. A task holds one batch of
    texts; a very long text is taken alone and whole, with about 150 bytes of arrays a word.
    """
    docs = docs.drop("runs", "n_words", "collapsed")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            for low, high in blocks(offsets):
                columns = _collapsed(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(low, high - low).columns, *columns], [f"c{i}" for i in range(len(names) + 3)])

    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    added = RUNS.split(", n_words")[0].split(" ", 1)[1], "LONG", "STRING"
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = own.mapInArrow(run, ", ".join(f"c{i} {t}" for i, t in enumerate([*kinds, *added])))
    return out.toDF(*names, "runs", "n_words", "collapsed")


def _collapsed(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    starts, ends, rows = word_spans(data, offsets)
    row, start, length, period = runs(_symbols(data, starts, ends, rows), rows)
    counts = np.append(0, np.cumsum(np.bincount(row, minlength=len(rows) - 1)))
    spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
    keep = kept_words(len(starts), rows, row, start, length, period)
    s, size = starts[keep], (ends - starts)[keep] + 1
    left = np.append(0, np.cumsum(keep))[rows]
    # One space behind each word but a text's last.
    size[left[1:][np.diff(left) > 0] - 1] -= 1
    text = np.full(int(size.sum()), 0x20, np.uint8)
    word = (ends - starts)[keep]
    text[ranges(np.cumsum(size) - size, word)] = data[ranges(s, word)]
    begins = np.append(0, np.cumsum(size))[left]
    joined = pa.LargeStringArray.from_buffers(len(rows) - 1, pa.py_buffer(begins), pa.py_buffer(text)).cast(pa.string())
    return [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans), pa.array(np.diff(rows).astype(np.int64)), joined]


def run_digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent, and digests of all runs and of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, texts = batch.columns
            rows = []
            for spans, text in zip(lists.to_pylist(), texts.to_pylist(), strict=True):
                best = max(spans, key=lambda r: (r["length"], -r["start"], -r["period"]), default=None)
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in spans)
                rows.append((
                    len(spans), *([best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]] if best else [None] * 4),
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], ["id", *DIGESTS])

    kind = found.schema[id_column].dataType.simpleString()
    out = found.select(F.col(id_column).alias("id"), "runs", "collapsed").mapInArrow(
        run, f"id {kind}, n_runs LONG, start LONG, length LONG, period LONG, exponent_milli LONG, runs_sha256 STRING, collapsed_sha256 STRING")
    return out.withColumnRenamed("id", id_column)


DIGESTS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail in one document of ten, its words joined by one space there.

    With h the checksum of the id and g = h div 10: where h mod 10 is 0, word i >= a becomes word
    a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null id has no
    checksum and keeps its text.
    """
    h = F.crc32(doc_id.cast("string"))

    def tail(words: Column, g: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")

    # One value in an array binds what the lambdas would else compute for each word.
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"), F.floor(h / 10).cast("long").alias("g"))
    some = F.transform(F.array(parts), lambda s: F.when(F.size(s["words"]) > 0, tail(s["words"], s["g"])).otherwise(text))
    return F.when(h % 10 == 0, some[0]).otherwise(text)
