"""Vectorised reading of Arrow text columns: words, hashes and spans of hashes.

Everything works on the column's own buffers, one block of documents at a time, so no
Python code runs per document or word. Words are the runs ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; arrays of 8 bytes each stay near the cache.
BLOCK = 1 << 19

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Random-looking value of each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
#: Span hashes are polynomials modulo this prime; a power of two would let two strings of two
#: symbols collide whatever the base.
PRIME = (1 << 61) - 1
_P, _S31, _S30, _S61 = _U(PRIME), _U(31), _U(30), _U(61)
_LOW31, _LOW30 = _U((1 << 31) - 1), _U((1 << 30) - 1)
_BASE = 0x0D1342543DE82EF9
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2^31 modulo the prime, for x below it; not fully reduced."""
    return (x >> _S30) + ((x & _LOW30) << _S31)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for values below it."""
    a_high, a_low, b_high, b_low = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    return _reduced(((a_high * b_high) << _U(1)) + _shifted(a_high * b_low + a_low * b_high) + a_low * b_low)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, PRIME))):
            known = _powers[k]
            while len(known) < max(n, BLOCK + 1):
                known = np.concatenate([known, times(known, np.full(len(known), pow(base, len(known), PRIME), _U))])
            _powers[k] = known
    return _powers[0], _powers[1]


#: Symbols whose running sums fit 64 bits.
LONGEST = 1 << 24


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span follows in one step.

    ``values`` are bytes or 64-bit hashes, at most ``LONGEST``.
    """
    n = len(values)
    if n > LONGEST:
        raise ValueError(f"{n} symbols are too many for one table of sums")
    up, _ = _powers_to(n + 1)
    out = np.zeros((2, n + 1), _U)
    if values.dtype == np.uint8:
        value = values.astype(_U) + _U(1)
        np.cumsum(value * (up[:n] >> _S31), out=out[0, 1:])
        np.cumsum(value * (up[:n] & _LOW31), out=out[1, 1:])
    else:
        term = times(_reduced(values), up[:n])
        np.cumsum(term >> _S31, out=out[0, 1:])
        np.cumsum(term & _LOW31, out=out[1, 1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal spans have equal hashes wherever they lie."""
    _, down = _powers_to(sums.shape[1])
    high, low = (_reduced(sums[k][end] - sums[k][start]) for k in (0, 1))
    return mix(times(_reduced(_shifted(high) + low), down[: sums.shape[1]][start]))


def chained(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` neighbours of 64-bit values, by doubling; of fewer values there are none."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, size, part = None, 1, values
    done = 0
    while True:
        if width & size:
            piece = part[done : done + n]
            out = mix(piece ^ _U(size)) if out is None else mix(out * _U(0x9E3779B97F4A7C15) ^ piece)
            done += size
        if done == width:
            return out
        part = mix(part[: len(part) - size] * _U(0x9E3779B97F4A7C15) ^ part[size:])
        size *= 2


_ODD = _U(0xD1342543DE82EF95)
_odd_powers: list[np.ndarray] = []


def _quick_powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _odd_powers or len(_odd_powers[0]) < n:
        inverse = _U(pow(int(_ODD), -1, 1 << 64))
        _odd_powers[:] = [np.multiply.accumulate(np.append(_U(1), np.full(max(n, BLOCK), base))) for base in (_ODD, inverse)]
    return _odd_powers


def quick_sums(values: np.ndarray) -> np.ndarray:
    """``prefix`` of 64-bit values modulo 2^64: five times as fast, but some long words of two letters collide whatever the base."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _quick_powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def quick_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _quick_powers(len(sums))[1][start])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row is alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each row's words begin."""
    inside = ~SPACES[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and where each row's words begin. Long rows are hashed in pieces."""
    starts, ends, rows = word_spans(data, offsets)
    return spelled_hashes(data, starts, ends), rows


def spelled_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each of the given words, in the order of their places."""
    if len(data) <= 4 * BLOCK:
        return span_hash(prefix(data), starts, ends)
    out, low = [], 0
    while low < len(starts):
        high = max(int(np.searchsorted(ends, starts[low] + BLOCK, side="right")), low + 1)
        piece = data[starts[low] : ends[high - 1]]
        out.append(span_hash(prefix(piece), starts[low:high] - starts[low], ends[low:high] - starts[low]))
        low = high
    return np.concatenate(out) if out else np.zeros(0, _U)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, size, out = len(values) - width + 1, 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[width - size : width - size + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(shift - starts, lengths)
