"""Exact token-sequence similarity for pairs that survived the filters.

Small per-row helpers behind Arrow UDFs. The longest-common-subsequence bound is a
bit-parallel count on Python integers and rejects most pairs before the exact score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinspan import constants as C
from twinspan.functions import run_batches

_DELIMITERS = frozenset(C.DELIMITERS)
SLACK = 1e-9
# Weight by the last two bits of a token code.
CLASS_WEIGHTS = np.array([C.DELIMITER_WEIGHT, C.IDENTIFIER_WEIGHT, C.OTHER_WEIGHT, 0])


def weight(token: str) -> int:
    if token in _DELIMITERS:
        return C.DELIMITER_WEIGHT
    return C.IDENTIFIER_WEIGHT if token.startswith("ID_") else C.OTHER_WEIGHT


def copies(codes: np.ndarray) -> np.ndarray:
    """How often each code stands in its list's joint sequence: as often as its weight holds that of an identifier.

    The weight of an identifier times the common subsequence of two such sequences is no less than what identifiers and heavier tokens add to a match.
    """
    times = -(-CLASS_WEIGHTS // C.IDENTIFIER_WEIGHT)
    times[CLASS_WEIGHTS < C.IDENTIFIER_WEIGHT] = 0
    return times[codes & 3]


def common_length(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Bit-parallel longest common subsequence length."""
    if not n or not other:
        return 0
    full = (1 << n) - 1
    v = full
    for t in other:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Profile:
    """One coded token list with what repeated comparisons need.

    A code holds a token's hash and, in its last two bits, its weight class.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.kind = codes & 3
        self.weights = CLASS_WEIGHTS[self.kind]
        self.total = int(self.weights.sum())
        self.tokens, self.counts = np.unique(codes, return_counts=True)
        self._parts: dict[int, list[int]] = {}
        self._masks: dict[int, dict[int, int]] = {}
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = np.concatenate([[0], np.cumsum(self.weights)])
        return self._prefix

    def part(self, kind: int) -> list[int]:
        if kind not in self._parts:
            self._parts[kind] = self.codes[self.kind == kind].tolist()
        return self._parts[kind]

    def masks(self, kind: int) -> dict[int, int]:
        if kind not in self._masks:
            found: dict[int, int] = {}
            for i, t in enumerate(self.part(kind)):
                found[t] = found.get(t, 0) | (1 << i)
            self._masks[kind] = found
        return self._masks[kind]


def bag_by_class(a: Profile, b: Profile) -> np.ndarray:
    """Weighted bag intersection, one figure per weight class."""
    if not len(a.codes) or not len(b.codes):
        return np.zeros(3)
    at = np.searchsorted(b.tokens, a.tokens)
    at[at == len(b.tokens)] = 0
    common = b.tokens[at] == a.tokens
    both = np.minimum(a.counts[common], b.counts[at[common]])
    kinds = a.tokens[common] & 3
    return np.bincount(kinds, weights=both, minlength=3)[:3] * CLASS_WEIGHTS[:3]


def matched_weight_bound(a: Profile, b: Profile, enough: float) -> float:
    """Upper bound of the matched weight: bags first, then subsequences per class.

    Stops once the bound is below ``enough``.
    """
    if not len(a.codes) or not len(b.codes):
        return 0
    best = bag_by_class(a, b)
    bound = best.sum()
    for kind in (1, 2, 0):
        if bound < enough:
            break
        common = common_length(b.masks(kind), len(b.part(kind)), a.part(kind))
        bound += CLASS_WEIGHTS[kind] * common - best[kind]
    return bound


def equal_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs a[i:i+n] == b[j:j+n] as arrays (i, j, n).

    Built from the positions of common tokens and sorted along diagonals; no
    len(a) x len(b) table.
    """
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    lo = np.searchsorted(b[by_b], a[by_a], "left")
    n = np.searchsorted(b[by_b], a[by_a], "right") - lo
    i = np.repeat(by_a, n)
    step = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    j = by_b[np.repeat(lo, n) + step]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    if not len(i):
        return i, j, i
    fresh = np.ones(len(i), dtype=bool)
    fresh[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
    at = np.flatnonzero(fresh)
    return i[at], j[at], np.diff(np.append(at, len(i)))


def _bag_weight(a: np.ndarray, b: np.ndarray, weights_a: np.ndarray) -> float:
    """Weighted bag intersection of two stretches of tokens."""
    ta, first, na = np.unique(a, return_index=True, return_counts=True)
    tb, nb = np.unique(b, return_counts=True)
    at = np.searchsorted(tb, ta)
    at[at == len(tb)] = 0
    return float((np.where(tb[at] == ta, np.minimum(na, nb[at]), 0) * weights_a[first]).sum())


# Stretches shorter than this are bounded by their weight alone.
SHORT = 24


def matched_weight(
    a: np.ndarray, b: np.ndarray, sum_a: np.ndarray, sum_b: np.ndarray, need: float = 0.0
) -> float:
    """Weight of the blocks that longest-run-first matching finds.

    The longest equal run is taken (earliest in ``a``, then in ``b``), then the parts
    before and after it likewise. ``sum_a``/``sum_b`` are running weights. What the
    open parts can still add is bounded by their weights and bags, so the search ends
    as soon as ``need`` is out of reach (the returned figure is then below ``need``).
    """
    weights = np.diff(sum_a)

    def room(a0: int, a1: int, b0: int, b1: int) -> float:
        most = min(sum_a[a1] - sum_a[a0], sum_b[b1] - sum_b[b0])
        if need > 0 and min(a1 - a0, b1 - b0) >= SHORT:
            most = min(most, _bag_weight(a[a0:a1], b[b0:b1], weights[a0:a1]))
        return most

    bound = room(0, len(a), 0, len(b)) if len(a) and len(b) else 0
    parts = [(0, len(a), 0, len(b), bound, *equal_runs(a, b))]
    while parts and bound >= need:
        a0, a1, b0, b1, cap, i, j, n = parts.pop()
        skip = np.maximum(np.maximum(a0 - i, b0 - j), 0)
        i, j = i + skip, j + skip
        n = np.minimum(n - skip, np.minimum(a1 - i, b1 - j))
        live = n > 0
        i, j, n = i[live], j[live], n[live]
        if not len(n):
            bound -= cap
            continue
        size = n.max()
        top = np.flatnonzero(n == size)
        best = top[np.lexsort((j[top], i[top]))[0]]
        x, y = int(i[best]), int(j[best])
        got = sum_a[x + size] - sum_a[x]
        for part in ((a0, x, b0, y), (x + size, a1, y + size, b1)):
            if part[0] < part[1] and part[2] < part[3]:
                most = room(*part)
                got += most
                parts.append((*part, most, i, j, n))
        bound -= cap - got
    return float(bound)


def _matched(x: Profile, y: Profile, need: float) -> float:
    return matched_weight(x.codes, y.codes, x.prefix, y.prefix, need)


def near_miss_score(a: Profile, b: Profile, at_least: float = 0.0) -> float | None:
    """Weighted share of matched tokens, the lower of both directions.

    None when it provably stays below ``at_least``.
    """
    total = a.total + b.total
    if not total:
        return 0.0 if at_least <= 0 else None
    need = (at_least - SLACK) * total / 2
    if at_least > 0 and matched_weight_bound(a, b, need) < need:
        return None
    first = _matched(a, b, need)
    if first < need:
        return None
    best = min(first, _matched(b, a, need))
    return 2 * best / total if best >= need else None


def sequence_similarity(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 0.0
    number = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([number[t] for t in v]) for v in (a, b))
    matched = matched_weight(x, y, np.arange(len(x) + 1), np.arange(len(y) + 1))
    return 2.0 * matched / (len(x) + len(y))


def _joined(columns: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The elements of the lists of several columns end to end, and where each list begins; a null is empty."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in columns])
    return pa.concat_arrays([c.flatten() for c in columns]), np.append(0, np.cumsum(sizes))


def _judged(a: pa.Array, b: pa.Array, names: tuple[pa.Array, pa.Array] | None, judge) -> np.ndarray:
    """What ``judge`` says of the pairs of lists of two columns of codes, some pairs at a time; a list moves once for each name.

    ``judge`` takes the codes of some lists end to end, and begin and end of both sides of each pair.
    """
    n = len(a)
    values, offsets = _joined([a, b])
    rows = np.arange(2 * n)
    if names is not None:
        name = pa.chunked_array(names).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        rows = np.unique(name, return_index=True)[1][name]
    return _grouped(values.to_numpy(zero_copy_only=False), offsets, rows[:n], rows[n:], judge)


def _grouped(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, judge) -> np.ndarray:
    """What ``judge`` says of pairs of lists, given by their numbers; ``values`` holds all lists end to end."""
    out, sizes = np.zeros(len(a)), np.diff(offsets)
    group = np.cumsum(sizes[a] + sizes[b]) // run_batches.TOKENS
    for g in np.unique(group):
        low, high = np.searchsorted(group, [g, g + 1])
        used, at = np.unique(np.append(a[low:high], b[low:high]), return_inverse=True)
        begin = np.append(0, np.cumsum(sizes[used]))
        sides = np.stack([begin[at], begin[at + 1]], 1)
        out[low:high] = judge(values[run_batches.ranges(offsets[used], sizes[used])], sides[: high - low], sides[high - low :])
    return out


def pair_scores(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, at_least: float) -> np.ndarray:
    """``near_miss_score`` of pairs of coded lists, given by their numbers among the lists end to end; nan for none."""
    return _grouped(values, offsets, a, b, lambda codes, x, y: _scores(codes, x, y, at_least))


def _scores(codes: np.ndarray, a: np.ndarray, b: np.ndarray, at_least: float) -> np.ndarray:
    """``near_miss_score`` of pairs of lists; nan for none."""
    if len(codes) > run_batches.MOST:
        found = [near_miss_score(Profile(codes[x:y]), Profile(codes[u:v]), at_least) for (x, y), (u, v) in zip(a, b)]
        return np.array([np.nan if s is None else s for s in found])
    tokens = run_batches.Tokens(codes, CLASS_WEIGHTS[codes & 3])
    total = sum(tokens.sums[s[:, 1]] - tokens.sums[s[:, 0]] for s in (a, b))
    need = (at_least - SLACK) * total / 2
    best = run_batches.matched_weights(tokens, a, b, need)
    near = np.flatnonzero(best >= need)
    best[near] = np.minimum(best[near], run_batches.matched_weights(tokens, b[near], a[near], need[near]))
    score = np.where(total > 0, 2 * best / np.maximum(total, 1), 0.0)
    return np.where((best >= need) & ((total > 0) | (at_least <= 0)), score, np.nan)


def near_miss_udf(at_least: float):
    """Arrow UDF (key_a, key_b, codes_a, codes_b) -> score, null below ``at_least``; equal keys have equal codes."""

    @F.arrow_udf(T.DoubleType())
    def score(key_a: pa.Array, key_b: pa.Array, codes_a: pa.Array, codes_b: pa.Array) -> pa.Array:
        found = _judged(codes_a, codes_b, (key_a, key_b), lambda codes, a, b: _scores(codes, a, b, at_least))
        return pa.array(found, pa.float64(), from_pandas=True)

    return score


def _ratios(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``sequence_similarity`` of pairs of lists."""
    size_a, size_b = a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]
    if len(codes) > run_batches.MOST:
        ones = np.arange(len(codes) + 1)
        matched = np.array([matched_weight(codes[x:y], codes[u:v], ones[: y - x + 1], ones[: v - u + 1]) for (x, y), (u, v) in zip(a, b)])
    else:
        tokens = run_batches.Tokens(codes, np.ones(len(codes), np.int64))
        matched = run_batches.matched_weights(tokens, a, b, np.zeros(len(a)))
    return np.where((size_a > 0) & (size_b > 0), 2.0 * matched / np.maximum(size_a + size_b, 1), 0.0)


def _coded(codes: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin - begin[0], pa.int32()), pa.array(codes[begin[0] : begin[-1]], pa.int64()))


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Plain token-sequence ratio; depends on the order of the two sides."""
    values, offsets = _joined([a, b])
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sides = [_coded(codes, offsets[k * len(a) : (k + 1) * len(a) + 1]) for k in (0, 1)]
    return pa.array(_judged(*sides, None, _ratios), pa.float64())
