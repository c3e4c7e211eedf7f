"""Consistent renaming of identifiers, vectorised over an Arrow batch.

A column expression would search the fragment's name list once per token, which is
quadratic; here a whole batch is ranked at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinspan import constants as C

_IDENTIFIER = regex.compile(C.IDENTIFIER_PATTERN)
_LITERAL = regex.compile(C.LITERAL_PATTERN)
_KEYWORDS = frozenset(C.KEYWORDS)
#: Tokens that are ranked at once, about; what this takes does not grow with the batch.
TOKENS = 1_000_000


def _kind(token: str) -> int:
    """1 for a renamable name, 2 for a literal, 0 for anything else."""
    if token in _KEYWORDS:
        return 0
    if _LITERAL.match(token):
        return 2
    return 1 if _IDENTIFIER.match(token) else 0


def row_slices(lists: pa.ListArray, most: int) -> list[tuple[int, int]]:
    """First and end row of stretches that hold about ``most`` elements; a longer row is taken whole."""
    ends = lists.offsets.to_numpy()
    out, low = [], 0
    while low < len(lists):
        high = max(int(np.searchsorted(ends, ends[low] + most, side="right")) - 1, low + 1)
        out.append((low, high))
        low = high
    return out


def rename_batch(tokens: pa.ListArray) -> pa.ListArray:
    parts = [_rename(tokens.slice(low, high - low)) for low, high in row_slices(tokens, TOKENS)]
    return pa.concat_arrays(parts) if parts else _rename(tokens)


def _rename(tokens: pa.ListArray) -> pa.ListArray:
    flat = pc.dictionary_encode(tokens.flatten())
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.dictionary.to_pylist()
    lengths = np.nan_to_num(pc.list_value_length(tokens).to_numpy(zero_copy_only=False)).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    kind = np.fromiter((_kind(w) for w in words), dtype=np.int64, count=len(words))[code] if len(code) else code

    names = np.flatnonzero(kind == 1)
    key = row[names] * max(len(words), 1) + code[names]
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    by_appearance = np.argsort(first, kind="stable")
    place = np.empty(len(first), dtype=np.int64)
    place[by_appearance] = np.arange(len(first))
    owner = row[names][first[by_appearance]]
    row_start = np.searchsorted(owner, np.arange(len(lengths)))
    rank = place[inverse] - row_start[row[names]]

    top = int(rank.max()) + 1 if len(rank) else 0
    labels = pa.array(words + ["LITERAL"] + [f"ID_{k}" for k in range(top)], pa.string())
    out = code.copy()
    out[kind == 2] = len(words)
    out[names] = len(words) + 1 + rank
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), labels.take(pa.array(out)))


@F.arrow_udf(T.ArrayType(T.StringType()))
def rename_identifiers(tokens: pa.Array) -> pa.Array:
    return rename_batch(tokens)
