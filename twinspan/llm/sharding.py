"""Sharding by a Feistel permutation of global row numbers.

The permutation is a bijection of 0 .. n-1 computed from the number alone, so a row's shard
and slot, and the row at a given shard and slot, need no table: ``place`` and ``row_at``
are inverse. Shard counts differ by at most one row, and slots have no gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from twinspan.llm.ranks import with_row_numbers
from twinspan.llm.symbols import mix

ROUNDS = 6
SEED = 20_240_601


def _sides(n: int) -> tuple[int, int]:
    """Two factors whose product is at least n and little more."""
    a = max(1, int(np.ceil(np.sqrt(n))))
    return a, max(1, -(-n // a))


def _noise(half: np.ndarray, step: int, seed: int, size: int) -> np.ndarray:
    key = np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
    return (mix(half.astype(np.uint64) ^ key) % np.uint64(size)).astype(np.int64)


def _forward(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    a, b = _sides(n)
    left, right = x // b, x % b
    for step in range(0, ROUNDS, 2):
        left = (left + _noise(right, step, seed, a)) % a
        right = (right + _noise(left, step + 1, seed, b)) % b
    return left * b + right


def _backward(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    a, b = _sides(n)
    left, right = y // b, y % b
    for step in reversed(range(0, ROUNDS, 2)):
        right = (right - _noise(left, step + 1, seed, b)) % b
        left = (left - _noise(right, step, seed, a)) % a
    return left * b + right


def _walk(x: np.ndarray, n: int, step, seed: int) -> np.ndarray:
    """Apply the permutation of the slightly larger square until the value is below n."""
    out = step(np.asarray(x, np.int64), n, seed)
    while (outside := out >= n).any():
        out[outside] = step(out[outside], n, seed)
    return out


def place(numbers, n: int, seed: int = SEED) -> np.ndarray:
    """The shuffled place of each row number below n."""
    return _walk(numbers, n, _forward, seed)


def row_at(shard: int, slot: int, shards: int, n: int, seed: int = SEED) -> int:
    """The row number that lies at a slot of a shard."""
    return int(_walk(np.array([slot * shards + shard]), n, _backward, seed)[0])


def assign_shards(numbered: DataFrame, shards: int, n: int, seed: int = SEED) -> DataFrame:
    """Append ``shard`` INT and ``slot`` LONG to a table with ``row_number`` 0 .. n-1.

    An empty table gets the two columns and no rows; columns of the same names are replaced.
    """

    @F.pandas_udf(LongType())
    def shuffled(numbers: pd.Series) -> pd.Series:
        return pd.Series(place(numbers.to_numpy(), n, seed))

    at = numbered.drop("shard", "slot").withColumn("_at", shuffled("row_number"))
    return at.withColumns({
        "shard": F.expr(f"CAST(_at % {shards} AS INT)"), "slot": F.expr(f"_at DIV {shards}")}).drop("_at")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for each row of ``docs``.

    size is the text's UTF-8 bytes plus 8; a null text has none. Row numbers follow doc_id,
    size and checksum, nulls first; repeated rows get numbers of their own. Columns other
    than doc_id and text play no part.
    """
    body = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"))
    numbered = with_row_numbers(narrow, [F.col(c) for c in ("doc_id", "size", "text_crc32")], "shard-order")
    return assign_shards(numbered, shards, max(1, numbered.count()), seed)
