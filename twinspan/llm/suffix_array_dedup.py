"""Removal of repeated byte strings with suffix arrays by prefix-free parsing.

Anchors bring together the regions that may share a string (``anchors``). Each task turns
the regions it holds into their suffix array by prefix-free parsing: a rolling hash marks
triggers, the text between two triggers (with the second trigger's bytes) is a phrase, and
equal phrases are kept once. No phrase suffix longer than a trigger is a prefix of another,
so sorting the dictionary's suffixes and the parse's suffixes sorts the text's: first by
what is left of the phrase, then by the parse that follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.llm.anchors import Region, Unit, covered, find_repeats, mask, merged, region_contents, solve
from twinspan.llm.substring_dedup import with_spans
from twinspan.llm.symbols import BYTE_VALUES, chained, prefix, quick_spans, quick_sums, ranges, span_hash

LENGTH = 400
GRAM = 16
UNIT = Unit(False, LENGTH, GRAM)
#: Bytes of a trigger, and one in how many places is one.
TRIGGER = 8
TRIGGER_RATE = 24
#: Bytes that are compared at once.
COMPARED = 4_000_000
#: Content bytes of the small anchors that are sorted together.
BATCH = 500_000


def _names(pairs: np.ndarray) -> np.ndarray:
    """Ranks of values: 1 for the least, equal values alike."""
    return np.unique(pairs, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)


#: Symbols of nine bits that fit one 64-bit number.
PACKED = 7


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray, longest: int, small: bool = False) -> np.ndarray:
    """Rank of each place's suffix, up to its string's end; equal suffixes rank alike.

    ``symbols`` are positive, ``ends`` has each place's end. Ranks double their reach until
    they cover ``longest`` symbols; behind an end comes 0, which sorts first. Symbols under
    512 (``small``) are compared seven at a time to begin with.
    """
    n, places = len(symbols), np.arange(len(symbols))
    key, reach = symbols.astype(np.uint64), 1
    if small:
        first, reach = key, PACKED
        key = first << np.uint64(9 * (PACKED - 1))
        for k in range(1, min(PACKED, n)):
            key[: n - k] |= np.where(places[k:] < ends[: n - k], first[k:], np.uint64(0)) << np.uint64(9 * (PACKED - 1 - k))
    rank = _names(key)
    while reach < longest:
        ahead = places + reach
        next_rank = np.where(ahead < ends, rank[np.minimum(ahead, n - 1)], np.uint64(0))
        rank = _names((rank << np.uint64(32)) | next_rank)
        reach *= 2
    return rank


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> None:
    """Raise unless the ranges at ``a`` and ``b`` hold the same bytes: hashes only propose equality."""
    ends = np.cumsum(sizes)
    low = 0
    while low < len(a):
        high = max(int(np.searchsorted(ends, ends[low] - sizes[low] + COMPARED, side="right")), low + 1)
        if (data[ranges(a[low:high], sizes[low:high])] != data[ranges(b[low:high], sizes[low:high])]).any():
            raise Collision
        low = high


class Collision(Exception):
    """Different strings have one hash."""


@dataclass(frozen=True)
class Hashes:
    """Running sums of bytes, and hashes of spans from them."""

    sums: Callable[[np.ndarray], np.ndarray]
    spans: Callable[..., np.ndarray]


#: Modulo 2^64: five times as fast, but some long words of two letters collide whatever the base.
QUICK = Hashes(lambda data: quick_sums(BYTE_VALUES[data]), quick_spans)
SURE = Hashes(prefix, span_hash)


class Parsing:
    """The prefix-free parsing of several strings, and their suffixes' order.

    Equal hashes only propose equal strings; where the bytes differ it is a ``Collision``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashes: Hashes = SURE):
        self.sums = hashes.sums(data)
        n, sizes = len(data), np.diff(offsets)
        # Phrases begin at strings' starts and at triggers that lie inside one string.
        begin = np.zeros(n, bool)
        begin[offsets[:-1][sizes > 0]] = True
        if n >= TRIGGER:
            marks = chained(BYTE_VALUES[data], TRIGGER) % np.uint64(TRIGGER_RATE) == 0
            room = np.repeat(offsets[1:], sizes) - np.arange(n) >= TRIGGER
            begin[: n - TRIGGER + 1] |= marks & room[: n - TRIGGER + 1]
        self.starts = np.flatnonzero(begin)
        string_end = np.repeat(offsets[1:], sizes)[self.starts]
        following = np.append(self.starts[1:], n)
        last = following >= string_end
        ends = np.where(last, string_end, np.minimum(following + TRIGGER, string_end))
        # A string's last phrase ends with the string and can't equal one that ends in a trigger.
        kinds = hashes.spans(self.sums, self.starts, ends) ^ np.where(last, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        _, first, phrase = np.unique(kinds, return_index=True, return_inverse=True)
        named = first[phrase]
        if (ends - self.starts != (ends - self.starts)[named]).any() or (last != last[named]).any():
            raise Collision
        _same_bytes(data, self.starts, self.starts[named], ends - self.starts)
        # The dictionary: each distinct phrase once, a string's last one with an end mark.
        size = ends[first] - self.starts[first]
        closing = last[first]
        full = size + closing
        at = np.cumsum(full) - full
        symbols = np.zeros(int(full.sum()), np.int64)
        symbols[ranges(at, size)] = data[ranges(self.starts[first], size)].astype(np.int64) + 2
        symbols[(at + size)[closing]] = 1
        dictionary = suffix_ranks(symbols, np.repeat(at + full, full), int(full.max(initial=1)), small=True)
        # The parse: phrase ranks, and the order of its suffixes within each string.
        order = dictionary[at][phrase]
        parse_end = np.searchsorted(self.starts, string_end)
        reach = int((parse_end - np.arange(len(order))).max(initial=1))
        self.parse = suffix_ranks(order, parse_end, reach)
        self.dictionary, self.at, self.phrase, self.parse_end = dictionary, at, phrase, parse_end

    def order_keys(self, places: np.ndarray) -> np.ndarray:
        """Keys that sort places as their suffixes: rest of the phrase, then the parse after it."""
        k = np.searchsorted(self.starts, places, side="right") - 1
        rest = self.dictionary[self.at[self.phrase[k]] + (places - self.starts[k])]
        inside = k + 1 < self.parse_end[k]
        after = np.where(inside, self.parse[np.minimum(k + 1, len(self.parse) - 1)], np.uint64(0))
        return (rest << np.uint64(32)) | after


def repeated_starts(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``_repeated_starts`` with hashes that are quick, or else with sure ones."""
    try:
        return _repeated_starts(data, offsets, length, QUICK)
    except Collision:
        return _repeated_starts(data, offsets, length, SURE)


def _repeated_starts(data: np.ndarray, offsets: np.ndarray, length: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in the row of each start of a ``length``-byte string that starts elsewhere too.

    Neighbours in suffix order share the longest prefixes, so a place is repeated if and only
    if it agrees with a neighbour over ``length`` bytes.
    """
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)
    places = ranges(offsets[:-1], counts)
    row = np.repeat(np.arange(len(sizes)), counts)
    if len(places) < 2:
        return row[:0], places[:0]
    parsing = Parsing(data, offsets, hashes)
    order = np.argsort(parsing.order_keys(places))
    strings = hashes.spans(parsing.sums, places[order], places[order] + length)
    same = strings[1:] == strings[:-1]
    # Neighbours that follow on one another in both places are compared as one.
    here, there = places[order[:-1][same]], places[order[1:][same]]
    by = np.argsort(here)
    here, there = here[by], there[by]
    new = np.flatnonzero(np.append(True, (np.diff(here) != 1) | (np.diff(there) != 1))[: len(here)])
    _same_bytes(data, here[new], there[new], np.diff(np.append(new, len(here))) - 1 + length)
    hit = np.sort(order[np.append(same, False) | np.append(False, same)])
    return row[hit], places[hit] - offsets[row[hit]]


def _solver(references: list[Region]):
    def probe(probes: list[Region]) -> Iterator[tuple[int, int, int]]:
        known = {id(r) for r in probes}
        regions = probes + [r for r in references if id(r) not in known]
        offsets = np.append(0, np.cumsum([len(r.content) for r in regions]))
        data = np.frombuffer(b"".join(r.content for r in regions), np.uint8)
        # Regions that stand in the corpus again as they are need no answer.
        once = np.array([k < len(probes) and r.n == 1 for k, r in enumerate(regions)])
        row, at = repeated_starts(data, offsets, LENGTH)
        asked = once[row]
        row, at = row[asked], at[asked]
        yield from zip(*(x.tolist() for x in merged(row, at, at + LENGTH)), strict=True)

    return probe


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, key, spans: bytes of each row that a string of 400 bytes found elsewhere covers."""
    found = find_repeats(docs, UNIT, "strings")
    copied = found.copies.select("doc", "key", "start", (F.col("start") + F.col("n_windows") + LENGTH - 1).alias("end"))
    compared = solve(region_contents(docs, found.mixed, UNIT), found.places, _solver, BATCH, "strings", LENGTH)
    return covered(copied.unionAll(compared))


def _kept(data, offsets, row, start, end):
    gone = mask(len(data), offsets[:-1], row, start, end)
    before = np.append(0, np.cumsum(gone))
    n_removed = np.diff(before[offsets])
    n_spans = np.bincount(row, minlength=len(offsets) - 1)
    return data[~gone], offsets - before[offsets], n_removed, n_spans


def _digests(data, offsets, row, start, end):
    left, begins, n_removed, n_spans = _kept(data, offsets, row, start, end)
    body = left.tobytes()
    kept = [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(begins[:-1], begins[1:], strict=True)]
    sizes = [pa.array(x.astype(np.int64)) for x in (np.diff(offsets), n_removed, n_spans)]
    texts = pa.array([body[a:b].decode("utf-8", "replace") for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.string())
    return [*sizes, pa.array(kept, pa.string()), texts]


def _remaining(data, offsets, row, start, end):
    left, begins, n_removed, _ = _kept(data, offsets, row, start, end)
    binary = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(left)])
    return [pa.array(n_removed.astype(np.int64)), binary.cast(pa.binary())]


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text of each row.

    ``text`` is what remains; a cut inside a character leaves U+FFFD there. Null text is
    empty. A repeated row repeats its strings. A very long text is cut into regions in pieces of
    4 MB that overlap. An empty table stays empty; further columns are not read.
    """
    return with_spans(
        docs, repeated_spans(docs), ["doc_id"], _digests, "n_bytes LONG, n_removed LONG, n_spans LONG, kept_sha256 STRING, text STRING")


def remove_strings(docs: DataFrame) -> DataFrame:
    """``docs`` with n_removed LONG and remaining BINARY; a cut may fall inside a character."""
    docs = docs.drop("n_removed", "remaining")
    return with_spans(docs, repeated_spans(docs), docs.columns, _remaining, "n_removed LONG, remaining BINARY")
