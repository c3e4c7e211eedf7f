"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.common import hard_rows, table, words
from twinspan.llm import periodic_runs, queries


def brute_runs(w):
    """(start, length, period) of each run, by start and period."""
    number = {x: i for i, x in enumerate(w)}
    a, n, out = np.array([number[x] for x in w], int), len(w), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], a[:-q] == a[q:], [False]]).astype(int)
        for i, j in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            length = j + q - i
            if length >= max(6, 4 * q) and not any((a[i:i + length - d] == a[i + d:i + length]).all() for d in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def tampered(doc, w):
    if doc is None:
        return w
    h, n = zlib.crc32(str(doc).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc, w):
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4),
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def ordered(rows):
    return sorted(rows, key=repr)


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, letters = rng.randrange(70), rng.choice([1, 2, 3, 20])
            w = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < .5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        offsets = np.cumsum([0, *map(len, texts)])
        symbols = np.array([100 * r + x for r, w in enumerate(texts) for x in w], np.int64)
        found = [[] for _ in texts]
        for row, *run in zip(*(x.tolist() for x in periodic_runs.runs(symbols, offsets)), strict=True):
            found[row].append(tuple(run))
        assert found == [brute_runs(w) for w in texts]


@pytest.mark.parametrize("word", ["fibonacci", "ones", "thue-morse", "nested"])
def test_runs_of_famous_words(word):
    if word == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 400:
            a, b = b, b + a
    elif word == "ones":
        b = [7] * 333
    elif word == "thue-morse":
        b = [bin(i).count("1") % 2 for i in range(512)]
    else:
        b = ([0] * 7 + [1]) * 6 + ([0, 1] * 5 + [2]) * 5
    found = periodic_runs.runs(np.array(b, np.int64), np.array([0, len(b)]))
    assert list(zip(*(x.tolist() for x in found[1:]))) == brute_runs(b)


def test_a_text_in_one_period_is_one_run_at_any_length():
    found = periodic_runs.runs(np.arange(300_000, dtype=np.int64) % 7919, np.array([0, 300_000]))
    assert [x.tolist() for x in found] == [[0], [0], [300_000], [7919]]


def test_wavelet_matrix_against_sorting():
    rng = np.random.default_rng(2)
    values = rng.permutation(777)
    tree = periodic_runs.WaveletMatrix(values, 10)
    low = rng.integers(0, 777, 500)
    high = low + 1 + rng.integers(0, 200, 500)
    high = np.minimum(high, 777)
    asked = values[low + (high - low) // 2]
    last, following = tree.neighbours(low, high, asked)
    for a, b, v, x, y in zip(low, high, asked, last, following):
        inside = values[a:b]
        assert x == max(inside[inside < v], default=-1) and y == min(inside[inside > v], default=-1)


def test_hard_rows(spark):
    rows = [*hard_rows(), (21, "go " * 5), (22, "go " * 6), (23, "a b a b a b a"), (24, "a b a b a b a b"), (25, "é è " * 9 + "x")]
    clashing = table(spark, rows).withColumns({c: F.lit("own") for c in ("runs", "n_words", "collapsed", "c0", "period", "start", "n_runs")})
    found = periodic_runs.find_runs(clashing)
    assert found.filter("period <> 'own' OR c0 <> 'own'").count() == 0
    assert ordered(map(tuple, periodic_runs.run_digests(found).collect())) == ordered(digest(i, words(t)) for i, t, *_ in rows)
    assert {(r.doc_id, r.n_words) for r in found.collect()} == {(i, len(words(t))) for i, t, *_ in rows}


def test_an_empty_table(spark):
    assert periodic_runs.run_digests(periodic_runs.find_runs(table(spark, []))).count() == 0


def test_planted_tails(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 60))) for i in range(300)] + [(None, "a b"), (3, None), (4, "")]
    docs = table(spark, rows).select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    assert ordered((r.doc_id, tuple(words(r.text))) for r in docs.collect()) == ordered((i, tuple(tampered(i, words(t)))) for i, t in rows)


def test_the_smallest_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op12_periodic_runs(spark, SMALL).collect()
    assert ordered(map(tuple, found)) == ordered(digest(r.doc_id, tampered(r.doc_id, words(r.text))) for r in rows)
    assert sum(r.n_runs for r in found) > 0


def test_a_text_beyond_one_block(spark):
    rng = random.Random(4)
    w = [f"w{rng.randrange(5000)}" for _ in range(90_000)]
    w[1000:1000] = ["x", "y", "z"] * 40
    rows = [(1, " ".join(w)), (2, "k " * 300_000)]
    found = {r.doc_id: r for r in periodic_runs.find_runs(table(spark, rows)).collect()}
    assert [tuple(r) for r in found[1].runs] == [(1000, 120, 3)] and found[1].collapsed.split() == w[:1003] + w[1120:]
    assert [tuple(r) for r in found[2].runs] == [(0, 300_000, 1)] and found[2].collapsed == "k"
