"""Blocks are packed and read where they meet: what is in them stays the same, and no list moves for a pair."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.test_bag_blocks import brute, found, given, random_rows
from tests.test_joint_bound import code_of, texts
from twinspan.operators import bag_blocks
from twinspan.operators.store import BATCH_BYTES, arrow_store, stage


def lists_of(rows, contents=None):
    codes = pa.array([code_of(t) for t in rows], pa.list_(pa.int64()))
    fields = [pa.array([f"n{k}" for k in range(len(rows))]), codes]
    if contents is not None:
        inner = pa.list_(pa.struct([("near_fp", pa.string()), ("codes", pa.list_(pa.int64()))]))
        fields.append(pa.array([[{"near_fp": n, "codes": code_of(t)} for n, t in c] for c in contents], inner))
    rows = pa.StructArray.from_arrays(fields, ["id", "codes", "contents"][: len(fields)])
    return bag_blocks.Lists(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)[0])


def again(lists, ordered):
    kinds = {"numbers": pa.binary(), "times": pa.binary(), "contents": pa.binary()}
    columns = {k: pa.scalar(v, kinds[k]) if k in kinds else pa.array([v.tolist() if isinstance(v, np.ndarray) else v.to_pylist()])[0]
               for k, v in lists.pack(ordered).items()}
    return bag_blocks.Lists.unpack(columns)


@pytest.mark.parametrize("ordered", [True, False])
def test_a_block_packed_and_unpacked(ordered):
    given_lists, others = lists_of(texts(5, 30, 90)[1:]), lists_of(texts(6, 30, 90)[1:])
    x, y = again(given_lists, ordered), again(others, ordered)
    for name in ("tokens", "row", "number", "count", "weight", "of_class", "most"):
        assert getattr(x, name).tolist() == getattr(given_lists, name).tolist()
    assert x.ids.to_pylist() == given_lists.ids.to_pylist()
    for got, expected in zip(bag_blocks.compare(x, y, 0.6, False, ordered), bag_blocks.compare(given_lists, others, 0.6, False, ordered)):
        assert got.tolist() == expected.tolist()


def test_contents_packed_and_unpacked():
    rows = [["ID_0", "=", "LITERAL"], ["ID_0", "("], ["and"]]
    contents = [[("p", ["ID_0", "=", "1"]), ("q", ["ID_0", "=", '"x"'])], [], [("r", ["and"])]]
    for c in (contents, [[], [], []]):
        lists = lists_of(rows, c)
        got = again(lists, True)
        for name in ("codes", "ends", "first", "values", "offsets"):
            assert getattr(got, name).tolist() == getattr(lists, name).tolist()
        assert got.names.to_pylist() == lists.names.to_pylist()


@pytest.mark.parametrize("numbers, size", [([0, 70_000], 8), ([0, 65_535], 4), ([], 0)])
def test_numbers_take_few_bytes(numbers, size):
    written = bag_blocks.small(np.array(numbers, np.int64), max(numbers, default=0) + 1)
    assert len(written) == size and bag_blocks.large(pa.scalar(written), len(numbers)).tolist() == numbers


@pytest.mark.parametrize("others", [False, True])
def test_groups_through_a_shuffle_where_arrow_knows_no_store(spark, monkeypatch, others):
    monkeypatch.setattr(bag_blocks, "BLOCK", 4)
    monkeypatch.setattr(bag_blocks, "arrow_store", lambda path: None)
    rows = random_rows(random.Random(8), 80)
    more = (given(spark, rows),) if others else ()
    got = found(bag_blocks.matching_pairs(given(spark, rows[:30] if others else rows), 0.75, False, "t", *more))
    assert set(got) == brute(rows[:30] if others else rows, 0.75, rows if others else None) and got


def test_no_list_moves_for_a_pair(spark, monkeypatch):
    monkeypatch.setattr(bag_blocks, "BLOCK", 4)
    met = bag_blocks.matching_pairs(given(spark, random_rows(random.Random(9), 40)), 0.75, True, "t")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "file_a" in plan
    assert not any(f"{c}#" in plan for c in ("lists", "words", "numbers", "codes"))


def test_few_tokens_are_unpacked_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(bag_blocks, "BLOCK", 4)
    monkeypatch.setattr(bag_blocks, "UNPACKED", {False: 30, True: 30})
    rows = random_rows(random.Random(10), 80)
    got = found(bag_blocks.matching_pairs(given(spark, rows), 0.75, False, "t"))
    assert sorted(got) == sorted(brute(rows, 0.75)) and got


def test_stores_and_batches(spark, tmp_path):
    before = spark.conf.get(BATCH_BYTES, None)
    rows = stage(spark.range(3), "a b")
    assert spark.conf.get(BATCH_BYTES, None) == before and rows.count() == 3
    assert arrow_store(rows.inputFiles()[0]) is not None
    assert arrow_store("viewfs://store/in/x") is None and arrow_store(f"file://{tmp_path}/none") is None and arrow_store(None) is None


def test_staged_jobs_hand_python_little_at_a_time(spark):
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    rows = spark.range(0, 40_000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 2000) AS text")
    with_small = stage(rows.mapInArrow(sizes, "n LONG"), "sizes").agg({"n": "max"}).first()[0]
    assert with_small <= 8 << 20


def test_steps_of_long_lists_are_counted_some_at_a_time(monkeypatch):
    """However long the lists of many pairs are, the rows of their tokens are not formed all at once."""
    monkeypatch.setattr(bag_blocks, "FEW", 0)
    rows, formed, common = texts(12, 24, 300)[1:], [], bag_blocks.Bits.common
    a, b = lists_of(rows), lists_of(texts(13, 24, 300)[1:])
    i, j = (x.ravel() for x in np.indices((len(b), len(a))))
    expected = bag_blocks.joint_subsequences(b, a, i, j, True)
    monkeypatch.setattr(bag_blocks, "STEPS", 900)
    monkeypatch.setattr(bag_blocks.Bits, "common", lambda self, row, *rest: formed.append(len(row)) or common(self, row, *rest))
    assert bag_blocks.joint_subsequences(b, a, i, j, True).tolist() == expected.tolist()
    assert len(formed) > 10 and max(formed) < 900 + 700


def test_places_that_agree_are_formed_some_at_a_time():
    # 2 lists of 3,000 equal tokens agree at 9 million places; what is formed together stays below a few MB a column.
    from twinspan.functions import run_batches as R

    assert R.PLACES * 8 <= 4 << 20 and R.TOKENS <= 100_000 and bag_blocks.TABLE <= 24 << 20
