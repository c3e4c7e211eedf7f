"""Longest-run-first matching of many pairs of token lists at once, in numpy.

The longest equal run of a pair is taken (earliest in the first list, then in the second), then
the parts before and after it likewise. Runs are looked for from the long ones down: stretches of
four tokens that both sides hold, and only in parts without any, of two. In what is left no two
tokens in a row agree, and one walk over the first side takes the single ones, so that the many
places where they agree are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Lengths of the stretches that runs are looked for by.
LEVELS = (4, 2, 1)
#: Tokens of the pairs that are matched together, and places that are formed together, about.
TOKENS = 100_000
PLACES = 500_000
#: Bits of a place in the key of a run.
_BITS = 21
_LOW = (1 << _BITS) - 1
#: Tokens that can be held together at all.
MOST = _LOW
#: Stays below every need, whatever is added to it.
LOST = -(1 << 60)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


class Tokens:
    """Lists end to end: running weights, and a hash of each stretch of 1, 2 and 4 tokens."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.sums = np.append(0, np.cumsum(weights)).astype(np.int64)
        self.weights = weights.astype(np.int64)
        self.grams = {1: _mix(codes.astype(np.int64).view(np.uint64))}
        for k in LEVELS[-2::-1]:
            half = self.grams[k // 2]
            ahead = np.append(half[k // 2 :], np.zeros(min(k // 2, len(half)), np.uint64))
            self.grams[k] = _mix(half * np.uint64(0x9E3779B97F4A7C15) + ahead)


class Parts:
    """Open parts: their pair, the places [a0, a1) and [b0, b1), and the most that each can add."""

    def __init__(self, pair, a0, a1, b0, b1, cap):
        self.pair, self.a0, self.a1, self.b0, self.b1, self.cap = pair, a0, a1, b0, b1, cap

    def __len__(self) -> int:
        return len(self.pair)

    def pick(self, kept: np.ndarray) -> Parts:
        return Parts(*(x[kept] for x in vars(self).values()))

    @staticmethod
    def all(them: list[Parts]) -> Parts:
        return Parts(*(np.concatenate(x) for x in zip(*(vars(p).values() for p in them))))

    def slots(self) -> np.ndarray:
        """A scrambled number for each part, unlike those of tokens with small codes."""
        return _mix(np.arange(len(self), dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


def _bags(tokens: Tokens, parts: Parts) -> np.ndarray:
    """Weighted bag intersection of both sides of each part."""
    sizes = (parts.a1 - parts.a0, parts.b1 - parts.b0)
    at = np.concatenate([ranges(parts.a0, sizes[0]), ranges(parts.b0, sizes[1])])
    part = np.concatenate([np.repeat(np.arange(len(parts)), n) for n in sizes])
    first = np.arange(len(at)) < int(sizes[0].sum())
    keys = tokens.grams[1][at] ^ parts.slots()[part]
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if not len(begin):
        return np.zeros(len(parts), np.int64)
    in_a = np.add.reduceat(first[order].astype(np.int64), begin)
    both = np.minimum(in_a, np.diff(np.append(begin, len(keys))) - in_a)
    token = order[begin]
    return np.bincount(part[token], both * tokens.weights[at[token]], len(parts)).astype(np.int64)


def _found(tokens: Tokens, parts: Parts, k: int) -> Iterator[tuple[Parts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts, and part, i, j, n of their maximal equal runs of at least ``k`` tokens; some parts at a time."""
    grams = tokens.grams[k]
    in_a, in_b = (np.maximum(high - low - k + 1, 0) for low, high in ((parts.a0, parts.a1), (parts.b0, parts.b1)))
    slots = parts.slots()
    at_a, at_b = ranges(parts.a0, in_a), ranges(parts.b0, in_b)
    part_a, part_b = np.repeat(np.arange(len(parts)), in_a), np.repeat(np.arange(len(parts)), in_b)
    keys_a, keys_b = grams[at_a] ^ slots[part_a], grams[at_b] ^ slots[part_b]
    by = np.argsort(keys_b)
    keys_b = keys_b[by]
    low = np.searchsorted(keys_b, keys_a, "left")
    low[low == len(keys_b)] = 0
    hit = np.flatnonzero(keys_b[low] == keys_a) if len(keys_b) else low[:0]
    at_a, part_a, low = at_a[hit], part_a[hit], low[hit]
    # How many stretches of the second side have the key at which a place was found.
    ends = np.append(np.flatnonzero(keys_b[1:] != keys_b[:-1]) + 1, len(keys_b))
    times = ends[np.searchsorted(ends, low, "right")] - low if len(hit) else low
    places = np.bincount(part_a, times, len(parts))
    group = np.cumsum(places) // PLACES
    for g in np.unique(group):
        lo, hi = np.searchsorted(group, [g, g + 1])
        x, y = np.searchsorted(part_a, [lo, hi])
        some = parts.pick(slice(lo, hi))
        n = times[x:y]
        i, part = np.repeat(at_a[x:y], n), np.repeat(part_a[x:y], n)
        from_b = by[ranges(low[x:y], n)]
        j = at_b[from_b]
        real = (part_b[from_b] == part) & (grams[i] == grams[j])
        part = part - lo
        # A run begins where the tokens before it differ, or a side begins.
        one = tokens.grams[1]
        real &= (i == some.a0[part]) | (j == some.b0[part]) | (one[i - 1] != one[j - 1])
        i, j, part = i[real], j[real], part[real]
        size = np.full(len(i), k)
        step = k
        while step:
            more = np.arange(len(i))
            while len(more):
                p, q, of = i[more] + size[more], j[more] + size[more], part[more]
                room = (p + step <= some.a1[of]) & (q + step <= some.b1[of])
                more, p, q = more[room], p[room], q[room]
                more = more[tokens.grams[step][p] == tokens.grams[step][q]]
                size[more] += step
            step //= 2
        yield some, part, i, j, size


def _split(tokens: Tokens, parts: Parts, runs: tuple[np.ndarray, ...], k: int, bound: np.ndarray, need: np.ndarray) -> list[Parts]:
    """Take the longest runs of all parts until none of ``k`` tokens is left; returns the parts that stay open."""
    part, i, j, n = runs
    sums, left = tokens.sums, []
    while len(parts):
        best = np.zeros(len(parts), np.int64)
        np.maximum.at(best, part, (n << 2 * _BITS) | ((_LOW - i) << _BITS) | (_LOW - j))
        done = best == 0
        if done.any():
            left.append(parts.pick(done))
            number = np.cumsum(~done) - 1
            parts, best, part = parts.pick(~done), best[~done], number[part]
            if not len(parts):
                break
        size, x, y = best >> 2 * _BITS, _LOW - (best >> _BITS & _LOW), _LOW - (best & _LOW)
        before = Parts(parts.pair, parts.a0, x, parts.b0, y, np.minimum(sums[x] - sums[parts.a0], sums[y] - sums[parts.b0]))
        u, v = x + size, y + size
        after = Parts(parts.pair, u, parts.a1, v, parts.b1, np.minimum(sums[parts.a1] - sums[u], sums[parts.b1] - sums[v]))
        np.add.at(bound, parts.pair, sums[u] - sums[x] + before.cap + after.cap - parts.cap)
        bound[bound < need] = LOST
        both = Parts.all([before, after])
        open_ = (bound >= need)[both.pair] & (both.a0 < both.a1) & (both.b0 < both.b1)
        number = np.cumsum(open_) - 1
        m = len(parts)
        behind = np.maximum(np.maximum(u[part] - i, v[part] - j), 0)
        n_before = np.minimum(n, np.minimum(x[part] - i, y[part] - j))
        n_after = n - behind
        keep_before, keep_after = (n_before >= k) & open_[part], (n_after >= k) & open_[part + m]
        part, i, j, n = (
            np.concatenate(c) for c in (
                (number[part[keep_before]], number[part[keep_after] + m]),
                (i[keep_before], (i + behind)[keep_after]), (j[keep_before], (j + behind)[keep_after]),
                (n_before[keep_before], n_after[keep_after])))
        parts = both.pick(open_)
    return left


def _singles(tokens: Tokens, parts: Parts) -> np.ndarray:
    """Matched weight of each part in which no two tokens in a row agree.

    Of runs of one token the earliest in the first list is taken, with its earliest place in the second; nothing
    before it agrees. So each place of the first side in turn takes the earliest place behind the last one taken.
    """
    out = np.zeros(len(parts), np.int64)
    sizes = (parts.a1 - parts.a0, parts.b1 - parts.b0)
    at_a, at_b = ranges(parts.a0, sizes[0]), ranges(parts.b0, sizes[1])
    part_a, part_b = (np.repeat(np.arange(len(parts)), n) for n in sizes)
    few, number = np.unique(tokens.grams[1][np.append(at_a, at_b)], return_inverse=True)
    key_a, key_b = part_a * len(few) + number[: len(at_a)], part_b * len(few) + number[len(at_a) :]
    keys, key_b = np.unique(key_b, return_inverse=True)
    if not len(keys):
        return out
    found = np.minimum(np.searchsorted(keys, key_a), len(keys) - 1)
    hit = keys[found] == key_a
    at_a, part_a, key_a = at_a[hit], part_a[hit], found[hit]
    # Places of the second side by part and token; a place of the first side looks for the next one.
    places = np.sort((key_b << _BITS) | at_b)
    steps = np.bincount(part_a, minlength=len(parts))
    by = np.argsort(-steps, kind="stable")
    begin, behind = (np.cumsum(steps) - steps)[by], parts.b0[by].copy()
    open_ = np.searchsorted(-steps[by], -np.arange(int(steps.max(initial=0))), "left")
    for step, m in enumerate(open_.tolist()):
        at = begin[:m] + step
        key = key_a[at]
        next_ = places[np.minimum(np.searchsorted(places, (key << _BITS) | behind[:m]), len(places) - 1)]
        taken = np.flatnonzero((next_ >> _BITS == key) & (next_ & _LOW >= behind[:m]))
        out[by[taken]] += tokens.weights[at_a[at[taken]]]
        behind[taken] = (next_[taken] & _LOW) + 1
    return out


def matched_weights(tokens: Tokens, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Matched weight of each pair; ``a`` and ``b`` hold the begin and end of its sides, one row a pair.

    A figure below the pair's ``need`` only says that the weight is below it.
    """
    sums = tokens.sums
    cap = np.minimum(sums[a[:, 1]] - sums[a[:, 0]], sums[b[:, 1]] - sums[b[:, 0]])
    bound = cap.copy()
    parts = Parts(np.arange(len(a)), a[:, 0], a[:, 1], b[:, 0], b[:, 1], cap).pick((cap > 0) & (bound >= need))
    for k in LEVELS:
        asked = need[parts.pair] > 0
        # Pairs come with bags that are large enough; parts need not have them.
        if k < LEVELS[0] and asked.any():
            some = parts.pick(asked)
            cap = np.minimum(some.cap, _bags(tokens, some))
            np.add.at(bound, some.pair, cap - some.cap)
            bound[bound < need] = LOST
            some.cap = cap
            parts = Parts.all([some.pick(cap > 0), parts.pick(~asked)])
            parts = parts.pick((bound >= need)[parts.pair])
        if k == 1:
            break
        left = [parts.pick(slice(0, 0))]
        for some, *runs in _found(tokens, parts, k):
            left += _split(tokens, some, tuple(runs), k, bound, need)
        parts = Parts.all(left)
        parts = parts.pick((bound >= need)[parts.pair])
    np.add.at(bound, parts.pair, _singles(tokens, parts) - parts.cap)
    return bound
