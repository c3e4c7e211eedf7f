"""Pairs of token lists that may match enough, compared block by block.

Lists are filed by weight band and by the share of their heavy and light tokens; files (cells)
whose extremes rule a match out never meet. A cell is cut into blocks of bounded size, and two
blocks are compared as matrices: one column per (token, occurrence) that both hold, one product
for the weighted bag overlap of all pairs. Pairs that pass it are bounded by common
subsequences, and scored if asked for, while their lists are at hand; only pairs that pass every bound leave a task.

Blocks are written once, packed: numbers of a block's own tokens in place of codes. A unit of work names two groups of
them; its task reads these from the shared folder and unpacks a few at a time, so that neither disk nor memory grows
with the number of blocks that meet. Where Arrow can't open the folder's store, groups move through a shuffle instead.

An index of elements would not do better here: renaming leaves no token rare, so lists of
similar weight share most elements whatever they say.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinspan import constants as C
from twinspan.functions.matching import CLASS_WEIGHTS, SLACK, Profile, common_length, copies, pair_scores
from twinspan.functions.run_batches import ranges
from twinspan.operators.store import arrow_store, stage

#: Lists and tokens of one block, about.
BLOCK = 256
TOKENS = 200_000
#: Blocks of a group at most; the blocks of a job and language make ``GROUPS`` groups before one holds more than one each.
HELD = 32
GROUPS = 12
#: Blocks that meet one group in one go: those of another group.
LANE = HELD
#: Tokens of the blocks that a task has unpacked at a time beside one of the group; fewer with what their order takes.
UNPACKED = {False: 1_500_000, True: 250_000}
#: Tokens of a file of packed blocks, about, and bytes of its row groups.
FILE = 2_000_000
PIECE = 4 << 20
#: Columns of a matrix that are multiplied at once.
COLUMNS = 4096
#: Partners in a block from which on a list meets all of the block at once.
CROWD = 16
#: Pairs whose subsequences are counted together, their steps in all, and bytes of a block's table of bits at most.
STEPPED = 4096
STEPS = 1_000_000
TABLE = 24_000_000
#: Pairs per word of bits below which they are counted one by one.
FEW = 16
#: Row of an identifier that stands once in a list.
LONE = -1
#: Parts into which the share of a weight class is cut.
SHARES = 8
CLASSES = range(3)
SCOPE = ["job_id", "language"]
CELL = [*SCOPE, "band", "share"]


def band_step(t: float) -> float:
    """Width of a weight band on a log scale: the permitted ratio of weights spans two, or less near a threshold of 1."""
    return max(-math.log(t / (2 - t)) / 2, 0.01)


def filed(rows: DataFrame, t: float) -> DataFrame:
    """``rows`` (job_id, language, id, codes) with their cell, weight and weight per class; empty lists go."""
    of_class = lambda k: F.size(F.filter("codes", lambda c: c.bitwiseAND(3) == k)).cast("long") * int(CLASS_WEIGHTS[k])
    weighed = rows.withColumns({f"w{k}": of_class(k) for k in CLASSES}).withColumn("weight", F.col("w0") + F.col("w1") + F.col("w2"))
    part = lambda k: F.floor(F.col(f"w{k}") * SHARES / F.col("weight")).cast("int")
    return weighed.filter("weight > 0").withColumns({
        "band": F.floor(F.log(F.col("weight").cast("double")) / band_step(t)).cast("int"), "share": part(0) * (SHARES + 1) + part(2)})


def cells(placed: DataFrame) -> DataFrame:
    """One row per cell: extremes of its lists, how many blocks it is cut into, the first one's number in the scope, and how many make a group."""
    table = placed.groupBy(*CELL).agg(
        F.min("weight").alias("lightest"), F.max("weight").alias("heaviest"), *[F.max(f"w{k}").alias(f"most{k}") for k in CLASSES],
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("codes")) / TOKENS)).cast("int").alias("blocks"),
        F.sum(F.size("codes")).alias("tokens"))
    scope = Window.partitionBy(*SCOPE)
    before = scope.orderBy("band", "share").rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({
        "first": F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int"),
        "held": F.least(F.ceil(F.sum("blocks").over(scope) / GROUPS), F.lit(HELD)).cast("int")})


def blocks(placed: DataFrame, table: DataFrame) -> DataFrame:
    """One row per block: its scope, group, number in the scope, ids and codes."""
    dealt = placed.join(table.select(*CELL, "blocks", "first", "held"), CELL)
    dealt = dealt.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
    dealt = dealt.withColumn("group", F.floor(F.col("block") / F.col("held")).cast("int"))
    held = [c for c in ("id", "codes", "contents") if c in placed.columns]
    return dealt.groupBy(*SCOPE, "group", "block").agg(F.sort_array(F.collect_list(F.struct(*held))).alias("lists"))


def block_pairs(left: DataFrame, right: DataFrame, t: float, same: bool) -> DataFrame:
    """Groups of blocks and the blocks they meet, of two tables of cells whose extremes allow a match.

    With ``same`` a block meets no group that lies wholly behind it. ``lane`` is the group of the block that is met.
    """
    def numbered(cells: DataFrame) -> DataFrame:
        number = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1))
        return cells.withColumn("block", number).withColumn("group", F.floor(F.col("block") / F.col("held")).cast("int"))

    ends = [F.min("lightest").alias("lightest"), F.max("heaviest").alias("heaviest"), *[F.max(f"most{k}").alias(f"most{k}") for k in CLASSES]]
    side = lambda d, s: d.select(*SCOPE, *[F.col(c).alias(f"{c}_{s}") for c in d.columns if c not in SCOPE])
    met = side(numbered(left).groupBy(*SCOPE, "group").agg(*ends), "a").join(side(numbered(right), "b"), SCOPE)
    most = sum((F.least(f"most{k}_a", f"most{k}_b") for k in CLASSES), F.lit(0))
    need = F.lit(t / 2) * (F.col("lightest_a") + F.col("lightest_b"))
    ratio = F.lit(t / (2 - t))
    met = met.filter((most + SLACK >= need) & (F.col("heaviest_a") + SLACK >= ratio * F.col("lightest_b")) & (F.col("heaviest_b") + SLACK >= ratio * F.col("lightest_a")))
    if same:
        met = met.filter("group_a <= group_b")
    return met.select(*SCOPE, "group_a", F.col("group_b").alias("lane"), F.col("block_b").alias("block"))


def may_match(a: Lists, b: Lists, t: float) -> bool:
    """Whether the extremes of two blocks allow a match."""
    (light_a, heavy_a, most_a), (light_b, heavy_b, most_b), ratio = a.extremes, b.extremes, t / (2 - t)
    return bool(
        np.minimum(most_a, most_b).sum() + SLACK >= t / 2 * (light_a + light_b)
        and heavy_a + SLACK >= ratio * light_b and heavy_b + SLACK >= ratio * light_a)


class Lanes:
    """The tokens of one weight class of many lists, side by side as bits, with a bit between that stops carries."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        sizes = np.diff(ends)
        self.begin = ends[:-1] + np.arange(len(sizes))
        self.sizes = sizes
        self.bits = int(ends[-1]) + len(sizes)
        place = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(codes, kind="stable")
        tokens, first = np.unique(codes[order], return_index=True)
        self.places = dict(zip(tokens.tolist(), np.split(place[order], first[1:]), strict=True)) if len(tokens) else {}
        self.full = self._number(place)
        self._masks: dict[int, int] = {}

    def _number(self, places: np.ndarray) -> int:
        flags = np.zeros(int(places[-1]) + 1 if len(places) else 0, np.uint8)
        flags[places] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def common(self, other: list[int]) -> np.ndarray:
        """Length of the longest common subsequence of ``other`` with each list."""
        v = full = self.full
        for t in other:
            mask = self._masks.get(t)
            if mask is None:
                if t not in self.places:
                    continue
                mask = self._masks[t] = self._number(self.places[t])
            u = v & mask
            v = ((v + u) | (v - u)) & full
        left = np.unpackbits(np.frombuffer(v.to_bytes(self.bits // 8 + 1, "little"), np.uint8), bitorder="little")
        before = np.append(0, np.cumsum(left, dtype=np.int64))
        return self.sizes - (before[self.begin + self.sizes] - before[self.begin])


class Bits:
    """Where each token stands in the ``JOINT`` sequence of each list of a block, as bits: one row of words a list and token.

    Unless ``whole``, identifiers that stand once in a list get no bit there: their row is ``LONE``.
    """

    def __init__(self, lists: Lists, whole: bool):
        codes, ends, lone = lists.joint(whole)
        sizes = np.diff(ends)
        list_ = np.repeat(np.arange(len(sizes)), sizes)
        self.tokens, token = np.unique(codes, return_inverse=True)
        # One column more, for tokens that no list has; row 0 is theirs.
        self.wide = len(self.tokens) + 1
        key = list_ * self.wide + token
        firm = ~lone
        before = np.append(0, np.cumsum(firm))
        place = before[:-1] - before[ends[:-1]][list_]
        self.words = -(-np.diff(before[ends]) // 64)
        n_words = int(self.words.max(initial=0))
        of, row = np.unique(key[firm], return_inverse=True)
        self.fits = (len(of) + 1) * n_words * 8 <= TABLE and len(sizes) * self.wide * 4 <= TABLE
        if not self.fits:
            return
        self.row = np.zeros(len(sizes) * self.wide, np.int32)
        self.row[key[lone]] = LONE
        self.row[of] = np.arange(1, len(of) + 1)
        self.table = np.zeros((n_words, len(of) + 1), np.uint64)
        # No bit is set twice, so that sums are unions.
        np.add.at(self.table, (place[firm] >> 6, row + 1), np.uint64(1) << (place[firm] & 63).astype(np.uint64))

    def common(self, row: np.ndarray, begin: np.ndarray, sizes: np.ndarray, n_words: int) -> np.ndarray:
        """Longest common subsequence of a list and the tokens whose rows are ``row[begin : begin + size]``, the longest first.

        All pairs take a step together, word by word; a carry goes to the next word.
        """
        n = len(begin)
        left = np.full((n_words, n), np.uint64(2**64 - 1))
        held, grown, carry = np.empty((3, n), np.uint64)
        top = np.uint64(63)
        open_ = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
        for step, m in enumerate(open_.tolist()):
            at = row[begin[:m] + step]
            for k in range(n_words):
                v, u, x, c = left[k, :m], held[:m], grown[:m], carry[:m]
                np.bitwise_and(v, self.table[k].take(at), out=u)
                np.add(v, u, out=x)
                if k:
                    x += c
                if k + 1 < n_words:
                    np.invert(x, out=c)
                    c &= v
                    c |= u
                    c >>= top
                v ^= u
                v |= x
        return 64 * n_words - np.bitwise_count(left).sum(0, dtype=np.int64)


def small(numbers: np.ndarray, most: int) -> bytes:
    """Numbers below ``most`` in as few bytes each as will do."""
    return numbers.astype(np.uint16 if most <= 1 << 16 else np.uint32).tobytes()


def large(data: pa.Scalar, n: int) -> np.ndarray:
    """The ``n`` numbers that ``small`` has written."""
    return np.frombuffer(data.as_py(), np.uint16 if len(data.as_py()) == 2 * n else np.uint32).astype(np.int64)


class Lists:
    """The token lists of a block: ids, and (list, token, count) rows."""

    def __init__(self, lists: pa.ListScalar):
        rows = lists.values
        codes, ends = _flat(rows.field(1))
        tokens, number = np.unique(codes, return_inverse=True)
        key, count = np.unique(np.repeat(np.arange(len(rows)), np.diff(ends)) * max(len(tokens), 1) + number, return_counts=True)
        self._set(rows.field(0), tokens, key // max(len(tokens), 1), key % max(len(tokens), 1), count)
        self.codes, self.ends = codes, ends
        if rows.type.num_fields > 2:
            at = rows.field(2).offsets.to_numpy()
            inner = rows.field(2).values.slice(at[0], at[-1] - at[0])
            self.first, self.names = at - at[0], inner.field(0)
            self.values, self.offsets = _flat(inner.field(1))

    def _set(self, ids: pa.Array, tokens: np.ndarray, row: np.ndarray, number: np.ndarray, count: np.ndarray) -> None:
        self.ids, self.tokens, self.row, self.number, self.count = ids, tokens, row, number, count
        kind = tokens[number] & 3
        self.of_class = np.stack([np.bincount(row, CLASS_WEIGHTS[k] * count * (kind == k), len(ids)) for k in CLASSES], 1).astype(np.int64)
        self.weight = self.of_class.sum(1)
        self._profiles: dict[int, Profile] = {}
        self._lanes: dict[int, Lanes] = {}
        self._bits: dict[bool, Bits] = {}
        self._masks: dict[tuple[int, bool], tuple[int, dict[int, int], set[int]]] = {}

    @classmethod
    def unpack(cls, row: dict[str, pa.Scalar]) -> Lists:
        """The block of a row of ``packed``."""
        out = cls.__new__(cls)
        ids, ends, words = row["ids"].values, row["ends"].values.to_numpy(), row["words"].values.to_numpy()
        number, of = large(row["numbers"], int(ends[-1])), np.repeat(np.arange(len(ids)), np.diff(ends))
        if row["times"].is_valid:
            out._set(ids, words, of, number, large(row["times"], int(ends[-1])))
            return out
        key, count = np.unique(of * len(words) + number, return_counts=True)
        # Words of contents alone are no tokens of the lists.
        known = np.zeros(len(words), bool)
        known[number] = True
        out._set(ids, words[known], key // len(words), (np.cumsum(known) - 1)[key % len(words)], count)
        out.codes, out.ends = words[number], ends
        if "names" in row:
            out.first, out.names, out.offsets = row["first"].values.to_numpy(), row["names"].values, row["content_ends"].values.to_numpy()
            out.values = words[large(row["contents"], int(out.offsets[-1]))]
        return out

    def pack(self, ordered: bool) -> dict:
        """The columns of ``packed``; without ``ordered`` tokens and how often lists have them take the place of the lists."""
        if not ordered:
            return {
                "ids": self.ids, "words": self.tokens, "ends": np.append(0, np.cumsum(np.bincount(self.row, minlength=len(self)))),
                "numbers": small(self.number, len(self.tokens)), "times": small(self.count, int(self.count.max(initial=0)) + 1)}
        words, number = np.unique(np.append(self.codes, self.values) if hasattr(self, "names") else self.codes, return_inverse=True)
        out = {"ids": self.ids, "words": words, "ends": self.ends, "numbers": small(number[: len(self.codes)], len(words)), "times": None}
        if hasattr(self, "names"):
            out |= {"first": self.first, "names": self.names, "content_ends": self.offsets, "contents": small(number[len(self.codes) :], len(words))}
        return out

    @cached_property
    def extremes(self) -> tuple[int, int, np.ndarray]:
        """The least and the largest weight of a list, and the largest of each class."""
        return int(self.weight.min()), int(self.weight.max()), self.of_class.max(0)

    def __len__(self) -> int:
        return len(self.ids)

    def profile(self, i: int) -> Profile:
        if i not in self._profiles:
            self._profiles[i] = Profile(self.codes[self.ends[i] : self.ends[i + 1]])
        return self._profiles[i]

    def lanes(self, kind: int) -> Lanes:
        if kind not in self._lanes:
            own = self.codes & 3 == kind
            self._lanes[kind] = Lanes(self.codes[own], np.append(0, np.cumsum(own))[self.ends])
        return self._lanes[kind]

    @cached_property
    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """The ``JOINT`` sequences end to end, and their ends."""
        times = copies(self.codes)
        return np.repeat(self.codes, times), np.append(0, np.cumsum(times))[self.ends]

    @cached_property
    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place of ``sequences``: whether its token comes first there in its list, and how often the list has it."""
        codes, ends = self.sequences
        key = np.stack([np.repeat(np.arange(len(self)), np.diff(ends)), codes])
        order = np.lexsort(key[::-1])
        new = np.append(True, (np.diff(key[:, order]) != 0).any(0))[: len(codes)]
        first = np.zeros(len(codes), bool)
        first[order[new]] = True
        times = np.zeros(len(codes), np.int64)
        run = np.flatnonzero(new)
        times[order] = np.repeat(np.diff(np.append(run, len(codes))), np.diff(np.append(run, len(codes))))
        return first, times

    def joint(self, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``sequences``, and which places hold an identifier that stands once in its list; none if ``whole``."""
        codes, ends = self.sequences
        return codes, ends, np.zeros(len(codes), bool) if whole else (self.seen[1] == 1) & (codes & 3 == 1)

    def bits(self, whole: bool) -> Bits:
        if whole not in self._bits:
            self._bits[whole] = Bits(self, whole)
        return self._bits[whole]

    def masks(self, i: int, whole: bool) -> tuple[int, dict[int, int], set[int]]:
        """Of one list what ``Bits`` has of all: bits, places of each token, lone identifiers."""
        if (i, whole) not in self._masks:
            codes, ends, lone = self.joint(whole)
            own, alone = codes[ends[i] : ends[i + 1]], lone[ends[i] : ends[i + 1]]
            places: dict[int, int] = {}
            for k, t in enumerate(own[~alone].tolist()):
                places[t] = places.get(t, 0) | (1 << k)
            self._masks[i, whole] = int((~alone).sum()), places, set(own[alone].tolist())
        return self._masks[i, whole]

    @cached_property
    def most(self) -> np.ndarray:
        """The largest count of each of ``tokens``."""
        out = np.zeros(len(self.tokens), np.int64)
        np.maximum.at(out, self.number, self.count)
        return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of lists end to end, and where each begins and ends."""
    ends = lists.offsets.to_numpy()
    return lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False), ends - ends[0]


def overlaps(a: Lists, b: Lists, kind: int | None = None) -> np.ndarray:
    """Weighted bag overlap of every list of ``a`` with every list of ``b``, exact; of one weight class or all."""
    tokens, in_a, in_b = np.intersect1d(a.tokens, b.tokens, assume_unique=True, return_indices=True)
    if kind is not None:
        own = tokens & 3 == kind
        tokens, in_a, in_b = tokens[own], in_a[own], in_b[own]
    out = np.zeros((len(a), len(b)), np.float64)
    if not len(tokens):
        return out
    most = np.minimum(a.most[in_a], b.most[in_b])
    begin = np.append(0, np.cumsum(most))
    weight = np.repeat(CLASS_WEIGHTS[tokens & 3], most).astype(np.float32)

    def elements(x: Lists, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each occurrence, by column where there is more than one go."""
        at = np.full(len(x.tokens), -1)
        at[places] = np.arange(len(places))
        at = at[x.number]
        known = at >= 0
        at, row, count = at[known], x.row[known], x.count[known]
        count = np.minimum(count, most[at])
        column = ranges(begin[at], count)
        row = np.repeat(row, count)
        if begin[-1] <= COLUMNS:
            return row, column
        by = np.argsort(column.astype(np.uint16) if begin[-1] <= 1 << 16 else column, kind="stable")
        return row[by], column[by]

    (row_a, column_a), (row_b, column_b) = elements(a, in_a), elements(b, in_b)
    for low in range(0, int(begin[-1]), COLUMNS):
        high = min(low + COLUMNS, int(begin[-1]))

        def matrix(n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray | float, low=low, high=high) -> np.ndarray:
            x, y = np.searchsorted(column, [low, high]) if begin[-1] > COLUMNS else (0, len(column))
            m = np.zeros((n, high - low), np.float32)
            m[row[x:y], column[x:y] - low] = value if np.isscalar(value) else value[column[x:y]]
            return m

        # Sums of at most 4,096 weights are exact in single precision.
        out += matrix(len(a), row_a, column_a, weight) @ matrix(len(b), row_b, column_b, 1.0).T
    return out


def subsequences(a: Lists, b: Lists, kind: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of one weight class for places of pairs, sorted by ``i``.

    A list with many partners in ``b`` meets all lists of ``b`` in one bit-parallel count.
    """
    out = np.zeros(len(i), np.int64)
    rows, first = np.unique(i, return_index=True)
    for row, low, high in zip(rows.tolist(), first.tolist(), [*first[1:].tolist(), len(i)]):
        own, others = a.profile(row).part(kind), j[low:high]
        if len(others) >= CROWD:
            out[low:high] = b.lanes(kind).common(own)[others]
        else:
            for k, other in enumerate(others.tolist(), low):
                p = b.profile(other)
                out[k] = common_length(p.masks(kind), len(p.part(kind)), own)
    return out


def joint_subsequences(a: Lists, b: Lists, i: np.ndarray, j: np.ndarray, whole: bool) -> np.ndarray:
    """Length of the longest common subsequence of the ``JOINT`` sequences for places of pairs.

    Unless ``whole``, identifiers that stand once in ``b`` count as matched wherever ``a`` has them: an upper
    bound, which takes fewer and shorter steps. Many pairs take their steps together.
    """
    out, bits = np.zeros(len(i), np.int64), b.bits(whole)
    codes, ends = a.sequences
    alone = np.arange(len(i))
    if bits.fits:
        token, first = columns(bits.tokens, codes), a.seen[0]
        alone, order = [alone[:0]], np.argsort(bits.words[j], kind="stable")
        go = np.cumsum(np.maximum(np.diff(ends)[i[order]] / STEPS, 1 / STEPPED)).astype(int)
        for some in np.split(order, np.flatnonzero(np.diff(go)) + 1) if len(i) else []:
            n_words = int(bits.words[j[some[-1]]])
            if len(some) < FEW * (n_words + 1):
                alone.append(some)
                continue
            size = np.diff(ends)[i[some]]
            at = ranges(ends[i[some]], size)
            row = bits.row[np.repeat(j[some] * bits.wide, size) + token[at]]
            start = np.append(0, np.cumsum(size))
            lone = np.append(0, np.cumsum((row == LONE) & first[at]))[start]
            start = np.append(0, np.cumsum(row > 0))[start]
            size, row = np.diff(start), row[row > 0]
            by = np.argsort(-size, kind="stable")
            out[some] = np.diff(lone)
            if len(row):
                out[some[by]] += bits.common(row, start[:-1][by], size[by], n_words)
        alone = np.concatenate(alone)
    for k in alone.tolist():
        n, places, lone = b.masks(int(j[k]), whole)
        own = codes[ends[i[k]] : ends[i[k] + 1]].tolist()
        out[k] = common_length(places, n, [t for t in own if t in places]) + len(lone.intersection(own))
    return out


def columns(tokens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Number of each code among the sorted ``tokens``; how many there are for a code that is not among them."""
    few, back = np.unique(codes, return_inverse=True)
    at = np.searchsorted(tokens, few)
    known = at < len(tokens)
    known[known] = tokens[at[known]] == few[known]
    return np.where(known, at, len(tokens))[back]


def compare(a: Lists, b: Lists, t: float, same: bool, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs that reach ``t``, and their overlap; with ``ordered`` the order of tokens counts too."""
    of_class = [overlaps(a, b, k) for k in CLASSES] if ordered else []
    shared = sum(of_class) if ordered else overlaps(a, b)
    need = (t - SLACK) / 2 * (a.weight[:, None] + b.weight[None, :])
    hit = shared >= need
    if same:
        hit &= np.triu(np.ones_like(hit), 1)
    # By ``j``: what is made of the lists of ``a`` serves all blocks that are streamed past it.
    j, i = np.nonzero(hit.T)
    if ordered:
        # Bags give way to subsequences: of the heavy class first, which is short, then of it and identifiers together.
        def narrow(bound):
            kept = bound >= need[i, j]
            return i[kept], j[kept]

        i, j = narrow(shared[i, j] - of_class[2][i, j] + CLASS_WEIGHTS[2] * subsequences(b, a, 2, j, i))
        for whole in (False, True):
            i, j = narrow(of_class[0][i, j] + C.IDENTIFIER_WEIGHT * joint_subsequences(b, a, j, i, whole))
    return i, j, shared[i, j]


def scored(a: Lists, b: Lists, i: np.ndarray, j: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of places of pairs: pair, content of ``a``, content of ``b`` and exact score of the contents that reach ``t``."""
    n_b = np.diff(b.first)[j]
    n = np.diff(a.first)[i] * n_b
    pair = np.repeat(np.arange(len(i)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    x, y = a.first[i][pair] + k // n_b[pair], b.first[j][pair] + k % n_b[pair]
    score = pair_scores(
        np.append(a.values, b.values), np.append(a.offsets, a.offsets[-1] + b.offsets[1:]), x, y + len(a.offsets) - 1, t)
    near = np.flatnonzero(~np.isnan(score))
    return pair[near], x[near], y[near], score[near]


def scored_pairs(rows: DataFrame, t: float, name: str) -> DataFrame:
    """job_id, language, id_a, id_b, near_fp_a, near_fp_b, similarity: pairs of contents whose exact score reaches ``t``.

    ``rows`` are those of ``matching_pairs`` with ``contents`` (near_fp, codes), scored where the blocks meet. A list
    may have none at hand; its pairs that pass all bounds come without names and score.
    """
    text = rows.schema["contents"].dataType.elementType["near_fp"].dataType
    names = [T.StructField(c, text) for c in ("near_fp_a", "near_fp_b")]

    def judged(scope, a: Lists, b: Lists, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> Iterator[list[pa.Array]]:
        bare = np.flatnonzero((np.diff(a.first)[i] == 0) | (np.diff(b.first)[j] == 0))
        pair, x, y, score = scored(a, b, i, j, t)
        kind = a.names.type
        yield [*scope(len(bare)), a.ids.take(pa.array(i[bare])), b.ids.take(pa.array(j[bare])),
               pa.nulls(len(bare), kind), pa.nulls(len(bare), kind), pa.nulls(len(bare), pa.float64())]
        yield [*scope(len(pair)), a.ids.take(pa.array(i[pair])), b.ids.take(pa.array(j[pair])),
               a.names.take(pa.array(x)), b.names.take(pa.array(y)), pa.array(score)]

    return _met(rows, t, True, name, None, [*names, T.StructField("similarity", T.DoubleType())], judged)


def matching_pairs(rows: DataFrame, t: float, ordered: bool, name: str, others: DataFrame | None = None) -> DataFrame:
    """job_id, language, id_a, id_b, shared, weight_a, weight_b LONG: pairs whose weighted bags overlap by at least ``t`` (Dice).

    ``rows`` have job_id, language, id and codes (``token_codes``); pairs are formed within job
    and language, each once, in either order. ``ordered`` drops pairs whose common subsequences
    can't reach ``t`` either. With ``others`` each pair has one row of each table. Rows of equal
    ids are no pair; empty lists match nothing; an empty table gives no rows.

    A task holds a group of blocks and streams those it meets past them.
    """
    def judged(scope, a: Lists, b: Lists, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> Iterator[list[pa.Array]]:
        figures = [pa.array(x.astype(np.int64)) for x in (shared, a.weight[i], b.weight[j])]
        yield [*scope(len(i)), a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), *figures]

    rows = rows.select("job_id", "language", "id", "codes")
    figures = [T.StructField(c, T.LongType()) for c in ("shared", "weight_a", "weight_b")]
    return _met(rows, t, ordered, name, others, figures, judged)


def packed(held: DataFrame, table: DataFrame, ordered: bool, name: str) -> DataFrame:
    """One row per block of ``blocks``, its lists packed (``Lists.pack``); the blocks of a group are in one file, side by side."""
    lists = held.schema["lists"].dataType.elementType
    fields = {
        "ids": T.ArrayType(lists["id"].dataType), "words": T.ArrayType(T.LongType()), "ends": T.ArrayType(T.IntegerType()),
        "numbers": T.BinaryType(), "times": T.BinaryType()}
    if "contents" in lists.names:
        names = T.ArrayType(lists["contents"].dataType.elementType["near_fp"].dataType)
        fields |= {"first": T.ArrayType(T.IntegerType()), "names": names, "content_ends": T.ArrayType(T.IntegerType()), "contents": T.BinaryType()}
    own = [*SCOPE, "group", "block"]
    out = T.StructType([*[held.schema[c] for c in own], *[T.StructField(c, kind) for c, kind in fields.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = Lists(batch.column("lists")[k]).pack(ordered)
                arrays = [batch.column(c).slice(k, 1) for c in own]
                for x in columns.values():
                    if x is None or isinstance(x, bytes):
                        arrays.append(pa.array([x], pa.binary()))
                    else:
                        x = x if isinstance(x, pa.Array) else pa.array(x, pa.int64() if x is columns["words"] else pa.int32())
                        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
                yield pa.RecordBatch.from_arrays(arrays, out.names)

    size = table.agg(F.sum("tokens"), F.sum("blocks")).first()
    files = max(1, min(size[1] or 0, max(2 * held.sparkSession.sparkContext.defaultParallelism, (size[0] or 0) // FILE)))
    rows = held.mapInArrow(run, out).repartition(files, *SCOPE, "group").sortWithinPartitions(*own)
    return stage(rows, f"{name}-blocks", {"parquet.block.size": PIECE, "parquet.block.size.row.check.min": 4})


def _read(path: str, scope: dict[str, pa.Scalar], group: int) -> dict[int, dict[str, pa.Scalar]]:
    """The packed blocks of a group, by number."""
    system, at = arrow_store(path)
    wanted = (pc.field("group") == group) & (pc.field("job_id") == scope["job_id"]) & (pc.field("language") == scope["language"])
    found = pq.read_table(at, filesystem=system, filters=wanted, use_threads=False, partitioning=None)
    columns = [c for c in found.column_names if c not in (*SCOPE, "group")]
    return {(row := {c: found.column(c)[k] for c in columns}).pop("block").as_py(): row for k in range(found.num_rows)}


def _met(rows: DataFrame, t: float, ordered: bool, name: str, others: DataFrame | None, columns: list[T.StructField], judged) -> DataFrame:
    """Pairs that pass all bounds, as ``judged`` gives them; a unit of work is a group of blocks and the blocks of another that it meets."""
    def prepared(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        if not ordered:
            rows = rows.withColumn("codes", F.sort_array("codes"))
        placed = stage(filed(rows, t), f"{name}-filed")
        table = stage(cells(placed), f"{name}-cells")
        return table, packed(blocks(placed, table), table, ordered, name)

    table, held = prepared(rows, name)
    same = others is None
    other_table, other_held = (table, held) if same else prepared(others.select(*SCOPE, "id", "codes"), f"{name}-other")
    pairs = block_pairs(table, other_table, t, same)
    units = stage(pairs.groupBy(*SCOPE, "group_a", "lane").agg(F.collect_list("block").alias("met")), f"{name}-units")
    key = [*SCOPE, "group_a", "lane"]
    # Comparing takes far longer than moving, so the work is dealt by units, not by bytes.
    n = units.count()
    parts = max(1, min(n, max(8 * rows.sparkSession.sparkContext.defaultParallelism, n // 4)))
    kind = rows.schema["id"].dataType
    out = T.StructType([
        T.StructField("job_id", rows.schema["job_id"].dataType), T.StructField("language", rows.schema["language"].dataType),
        T.StructField("id_a", kind), T.StructField("id_b", kind),
        *columns])

    def compared(unit: dict[str, pa.Scalar], homes: dict, aways: dict) -> Iterator[pa.RecordBatch]:
        """Each block of a group against the blocks it meets, a few of which are unpacked at a time."""
        scope = lambda n: [pa.repeat(unit[c], n) for c in SCOPE]
        twin = same and unit["group_a"].as_py() == unit["lane"].as_py()
        order = sorted(aways)
        at = np.cumsum([aways[k]["ends"].values[-1].as_py() for k in order]) // UNPACKED[ordered]
        for g in np.unique(at):
            some = [(k, Lists.unpack(aways[k])) for k, go in zip(order, at, strict=True) if go == g]
            for number in sorted(homes):
                if twin and number > some[-1][0]:
                    break
                block = Lists.unpack(homes[number])
                for other, lists in some:
                    if twin and number > other or not may_match(block, lists, t):
                        continue
                    i, j, shared = compare(block, lists, t, twin and number == other, ordered)
                    for arrays in judged(scope, block, lists, i, j, shared):
                        if len(arrays[0]):
                            yield pa.RecordBatch.from_arrays(arrays, out.names)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                unit = {c: batch.column(c)[k] for c in batch.schema.names}
                group, lane, met = (unit[c].as_py() for c in ("group_a", "lane", "met"))
                homes = _read(unit["file_a"].as_py(), unit, group)
                aways = homes if same and group == lane else _read(unit["file_b"].as_py(), unit, lane)
                yield from compared(unit, homes, {b: aways[b] for b in met if b in aways})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, unit, sides = None, None, ({}, {})
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if (at := [row[c].as_py() for c in key]) != place:
                    if place:
                        yield from compared(unit, *sides)
                    place, unit, sides = at, row, ({}, {})
                sides[row["away"].as_py()][row["block"].as_py()] = row
        if place:
            yield from compared(unit, *sides)

    if arrow_store(held.inputFiles()[0] if n else None):
        where = lambda d, s, g: d.select(*SCOPE, F.col("group").alias(g), F.input_file_name().alias(f"file_{s}")).distinct()
        located = units.join(where(held, "a", "group_a"), [*SCOPE, "group_a"]).join(where(other_held, "b", "lane"), [*SCOPE, "lane"])
        met = located.repartition(parts, F.xxhash64(*key)).mapInArrow(fetch, out)
    else:
        side = lambda d, away: d.withColumn("away", F.lit(away)).drop("group")
        home = units.drop("met").join(held.withColumnRenamed("group", "group_a"), [*SCOPE, "group_a"])
        away = units.withColumn("block", F.explode("met")).drop("met").join(other_held, [*SCOPE, "block"])
        met = side(home, 0).unionByName(side(away, 1)).repartition(parts, F.xxhash64(*key)).sortWithinPartitions(*key, "away", "block")
        met = met.mapInArrow(gather, out)
    return met.filter("id_a <> id_b")
