"""Removal of long word passages that stand in an earlier document, by suffix automata.

Reference shards are suffix automata over words; documents are streamed past them for
matching statistics, and the maximal spans that match over the threshold go. The reference
is the corpus itself and has no size bound, so a shard is not broadcast to every task:
anchors bring each document's passages to just the shards that may hold them (``anchors``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.llm.anchors import NO_ID, Region, Unit, covered, find_repeats, mask, region_contents, solve, span_rows
from twinspan.llm.symbols import SPACES, blocks, ranges, text_buffers, word_spans

WINDOW = 50
GRAM = 8
#: Content bytes of the small anchors that share one automaton.
BATCH = 400_000


class SuffixAutomaton:
    """All substrings of the texts added so far; each state knows the first text that held it.

    Texts are added in ascending order of their number, so a new state's first text is the
    current one, and a clone's is that of the state it splits off.
    """

    def __init__(self) -> None:
        self.to: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [0]

    def add(self, symbols: list[int], number: int) -> None:
        to, link, length, first = self.to, self.link, self.length, self.first
        last = 0
        for c in symbols:
            q = to[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._split(last, q, c)
                continue
            new = len(to)
            to.append({})
            length.append(length[last] + 1)
            first.append(number)
            link.append(0)
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = new
                p = link[p]
            if p >= 0:
                q = to[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = new

    def _split(self, p: int, q: int, c: int) -> int:
        to, link = self.to, self.link
        clone = len(to)
        to.append(to[q].copy())
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        link.append(link[q])
        link[q] = clone
        while p >= 0 and to[p].get(c) == q:
            to[p][c] = clone
            p = link[p]
        return clone

    def matches(self, symbols: list[int], number: int, least: int) -> Iterator[tuple[int, int]]:
        """Maximal spans of ``symbols`` whose windows of ``least`` stand in a text of a smaller number.

        The matching statistic at each place is the longest suffix the automaton knows, as far
        as ``least``; the state that holds just that window names its first text.
        """
        to, link, length, first = self.to, self.link, self.length, self.first
        state, matched, begin, end = 0, 0, -1, -1
        for i, c in enumerate(symbols):
            while state and c not in to[state]:
                state = link[state]
                matched = length[state]
            if c in to[state]:
                state = to[state][c]
                matched += 1
                if matched > least:
                    matched = least
                while length[link[state]] >= matched and state:
                    state = link[state]
            if matched >= least and first[state] < number:
                if end < i - least + 1:
                    if end >= 0:
                        yield begin, end
                    begin = i - least + 1
                end = i + 1
        if end >= 0:
            yield begin, end


def _numbered(regions: list[Region]) -> list[list[int]]:
    """Each region's words as numbers, equal for equal words and no others."""
    data, offsets = text_buffers(pa.array([r.content for r in regions], pa.binary()).view(pa.string()))
    starts, ends, rows = word_spans(data, offsets)
    held = np.append(0, np.cumsum(ends - starts))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(held), pa.py_buffer(data[~SPACES[data]])])
    numbers = words.dictionary_encode().indices.to_pylist()
    return [numbers[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]


def _solver(references: list[Region]):
    def probe(probes: list[Region]) -> Iterator[tuple[int, int, int]]:
        at = {id(r): k for k, r in enumerate(probes)}
        others = [r for r in references if id(r) not in at]
        words = _numbered(probes + others)
        at.update((id(r), len(probes) + k) for k, r in enumerate(others))
        automaton = SuffixAutomaton()
        for r in references:
            automaton.add(words[at[id(r)]], r.doc)
        for i, r in enumerate(probes):
            for a, b in automaton.matches(words[i], r.doc, WINDOW):
                yield i, a, b

    return probe


def repeated_spans(docs: DataFrame, unit: Unit) -> DataFrame:
    """doc, key, spans: words of each row that stand in a passage of an earlier document."""
    found = find_repeats(docs, unit, "substrings")
    copied = found.copies.filter("doc > first_doc").select(
        "doc", "key", "start", (F.col("start") + F.col("n_windows") + unit.window - 1).alias("end"))
    compared = solve(region_contents(docs, found.mixed, unit), found.places, _solver, BATCH, "substrings")
    return covered(copied.unionAll(compared))


def with_spans(docs: DataFrame, spans: DataFrame, carried: list[str], finish, schema: str) -> DataFrame:
    """Join each row with its spans and let ``finish`` make the output columns of a block.

    ``carried`` columns pass unchanged; the text goes through the join once.
    """
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), F.xxhash64("text").alias("_key"),
        F.col("text").alias("_text"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(carried) if c != "text"])
    joined = named.join(spans.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), "spans"), ["_doc", "_key"], "left")
    sources = ["_text" if c == "text" else f"_in{i}" for i, c in enumerate(carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("_text"))
            for low, high in blocks(offsets):
                begins = offsets[low : high + 1] - offsets[low]
                own = [batch.column(c)[low:high] for c in sources]
                columns = finish(data[offsets[low] : offsets[high]], begins, *span_rows(batch.column("spans")[low:high]))
                yield pa.RecordBatch.from_arrays([*own, *columns], [f"c{i}" for i in range(len(own) + len(columns))])

    added = [f.split(" ", 1) for f in schema.split(", ")]
    kinds = [docs.schema[c].dataType.simpleString() for c in carried] + [t for _, t in added]
    out = joined.drop("_doc", "_key").mapInArrow(run, ", ".join(f"c{i} {t}" for i, t in enumerate(kinds)))
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate([*carried, *[n for n, _ in added]])])


def _joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each row, one space between, and the rows' offsets."""
    s, e = starts[keep], ends[keep]
    begins = np.append(0, np.cumsum(keep))[rows]
    filled = np.diff(begins) > 0
    sizes = e - s + 1
    sizes[begins[1:][filled] - 1] -= 1  # no space behind a row's last word
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    at = np.cumsum(sizes) - sizes
    out[ranges(at, e - s)] = data[ranges(s, e - s)]
    return out, np.append(0, np.cumsum(sizes))[begins]


def _finish(as_digest: bool):
    def finish(data, offsets, row, start, end):
        starts, ends, rows = word_spans(data, offsets)
        gone = mask(len(starts), rows[:-1], row, start, end)
        text, begins = _joined_words(data, starts, ends, rows, ~gone)
        n_removed = np.diff(np.append(0, np.cumsum(gone))[rows])
        if as_digest:
            body = text.tobytes()
            kept = pa.array([hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.string())
            return [pa.array(np.diff(rows).astype(np.int64)), pa.array(n_removed.astype(np.int64)), kept]
        left = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(text))
        # Only a text that lost words is written anew.
        left = pc.if_else(pa.array(n_removed > 0), left.cast(pa.string()), None)
        return [pa.array(n_removed.astype(np.int64)), left]

    return finish


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row.

    Null text has no words; a null doc_id comes before all others, and rows of one doc_id
    don't remove each other's words. An empty table stays empty; further columns are not read.
    """
    spans = repeated_spans(docs, Unit(True, WINDOW, GRAM))
    return with_spans(docs, spans, ["doc_id"], _finish(True), "n_words LONG, n_removed LONG, kept_sha256 STRING")


def remove_passages(docs: DataFrame) -> DataFrame:
    """Documents without the repeated passages; those that lose all their words go.

    A document that loses nothing keeps its text as it is; another keeps its remaining words
    joined by spaces. ``n_chars`` follows the text where the column exists.
    """
    spans = repeated_spans(docs, Unit(True, WINDOW, GRAM))
    own = [f"_own{i}" for i in range(len(docs.columns))]
    # Names of our own: the input's columns may clash with those that are added.
    out = with_spans(docs, spans, docs.columns, _finish(False), "n_removed LONG, left STRING").toDF(*own, "_n_removed", "_left")
    changed = F.col("_n_removed") > 0
    columns = []
    for name, held in zip(docs.columns, own, strict=True):
        column = F.col(held)
        if name == "text":
            column = F.when(changed, F.col("_left")).otherwise(column)
        elif name == "n_chars":
            column = F.when(changed, F.length("_left")).otherwise(column).cast(docs.schema[name].dataType)
        columns.append(column.alias(name))
    return out.filter(~changed | (F.col("_left") != "")).select(*columns)
