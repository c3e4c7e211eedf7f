"""Bag overlaps by blocks against counters, and what reaches the later stages at three scales."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from twinspan import constants as C
from twinspan.catalog import common as B
from twinspan.functions import text as X
from twinspan.functions.matching import weight
from twinspan.operators import bag_blocks
from twinspan.operators import near_miss as M

TOKENS = ["(", ")", ";", "{", "ID_0", "ID_1", "ID_2", "ID_9", "return", "+", "=", "1", '"x"']
SCHEMA = "job_id STRING, language STRING, id INT, toks ARRAY<STRING>"


def given(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("codes", X.token_codes("toks"))


def random_rows(rng, n):
    rows = []
    for i in range(n):
        base = rng.choice(rows)[3] if rows and rng.random() < .4 else [rng.choice(TOKENS) for _ in range(rng.randrange(40))]
        toks = list(base)
        for _ in range(rng.randrange(4)):
            toks[rng.randrange(len(toks) + 1):0] = [rng.choice(TOKENS)]
        rows.append((rng.choice(["j", "k"]), rng.choice(["c", "py"]), i, toks))
    return rows


def brute(rows, t, others=None):
    """(smaller id, larger id, shared) of pairs of the same scope."""
    out = set()
    for x in rows:
        for y in rows if others is None else others:
            if x[:2] != y[:2] or x[2] == y[2] or (others is None and x[2] > y[2]):
                continue
            total = sum(map(weight, x[3])) + sum(map(weight, y[3]))
            shared = sum(weight(k) * n for k, n in (Counter(x[3]) & Counter(y[3])).items())
            if total and x[3] and y[3] and 2 * shared >= (t - 1e-9) * total:
                out.add((min(x[2], y[2]), max(x[2], y[2]), shared))
    return out


def found(df):
    rows = [(min(r.id_a, r.id_b), max(r.id_a, r.id_b), r.shared) for r in df.collect()]
    return rows


@pytest.mark.parametrize("t, block", [(0.75, 256), (0.75, 5), (0.95, 3), (0.5, 7)])
def test_pairs_equal_brute_force(spark, monkeypatch, t, block):
    monkeypatch.setattr(bag_blocks, "BLOCK", block)
    monkeypatch.setattr(bag_blocks, "COLUMNS", 16)
    rows = random_rows(random.Random(block), 90)
    got = found(bag_blocks.matching_pairs(given(spark, rows), t, False, "t"))
    assert sorted(got) == sorted(brute(rows, t)) and got


def test_pairs_between_two_tables(spark, monkeypatch):
    monkeypatch.setattr(bag_blocks, "BLOCK", 6)
    rows = random_rows(random.Random(3), 80)
    some = rows[:25]
    got = found(bag_blocks.matching_pairs(given(spark, some), 0.75, False, "t", given(spark, rows)))
    assert set(got) == brute(some, 0.75, rows) and got


def test_order_only_drops_pairs_that_cannot_reach(spark):
    a, b = ["ID_0", "return", "ID_1", "ID_2"] * 8, ["ID_2", "ID_1", "return", "ID_0"] * 8
    rows = [("j", "c", 1, a), ("j", "c", 2, b), ("j", "c", 3, a[:-1]), ("j", "c", 4, []), ("j", "c", 5, None)]
    pick = lambda ordered: {r[:2] for r in found(bag_blocks.matching_pairs(given(spark, rows), 0.9, ordered, "t"))}
    assert pick(False) == {(1, 2), (1, 3), (2, 3)} and pick(True) == {(1, 3)}


def test_an_empty_table(spark):
    assert bag_blocks.matching_pairs(given(spark, []), 0.75, True, "t").count() == 0


def test_copies_of_one_id_are_no_pair(spark):
    rows = [("j", "c", 1, ["ID_0", "="])] * 3
    assert bag_blocks.matching_pairs(given(spark, rows), 0.75, True, "t").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_share_of_pairs_that_leave_the_blocks(spark, sf, capsys):
    """All documents as one job: few of all pairs of shapes reach the exact score, and no more at a larger scale."""
    rows = M.shapes(B.prints(spark, SMALL.replace("sf0.001", sf)).drop("tokens", "params", "code")).cache()
    sizes = [r["count"] for r in rows.groupBy(*M.KEY).count().collect()]
    n = M.shape_pairs(rows, C.NEAR_MISS_FLOOR, "t").count()
    share = n / sum(s * (s - 1) / 2 for s in sizes)
    with capsys.disabled():
        print(f" {sf}: {n} pairs, {100 * share:.2f} % of all")
    rows.unpersist()
    assert share < 0.02


def test_a_block_holds_no_more_than_its_tokens(spark, monkeypatch):
    monkeypatch.setattr(bag_blocks, "TOKENS", 100)
    rows = [("j", "c", i, ["ID_0", "="] * 30) for i in range(40)]
    placed = bag_blocks.filed(given(spark, rows), 0.75)
    table = bag_blocks.cells(placed)
    sizes = [r.n for r in bag_blocks.blocks(placed, table).select(F.size("lists").alias("n")).collect()]
    assert sum(sizes) == 40 and max(sizes) < 20
    assert np.prod([r.blocks for r in table.collect()]) == 24


def test_blocks_move_once_per_group_they_meet(spark, monkeypatch):
    monkeypatch.setattr(bag_blocks, "BLOCK", 1)
    rows = [("j", "c", i, ["ID_0", "="] * 5 + [f"ID_{i}"]) for i in range(200)]
    placed = bag_blocks.filed(given(spark, rows), 0.75)
    table = bag_blocks.cells(placed).cache()
    n = bag_blocks.blocks(placed, table).count()
    moved = bag_blocks.block_pairs(table, table, 0.75, True)
    assert table.count() == 1 and n > 100 and moved.count() < n * n / 12
    assert moved.groupBy("group_a", "lane").count().agg({"count": "max"}).first()[0] <= bag_blocks.LANE
    assert sorted(found(bag_blocks.matching_pairs(given(spark, rows[:60]), 0.75, False, "t"))) == sorted(brute(rows[:60], 0.75))
