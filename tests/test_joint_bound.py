"""Common subsequences of identifiers and heavier tokens together, against a plain table, and what is left to score."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SMALL
from tests.test_matching import plain_score
from tests.test_matching import TOKENS as FEW_TOKENS
from twinspan import constants as C
from twinspan.catalog import common as B
from twinspan.functions.matching import SLACK, copies, weight
from twinspan.operators import bag_blocks
from twinspan.operators import near_miss as M

TOKENS = [*FEW_TOKENS, "and", "."]


def block(texts):
    codes = pa.array([code_of(t) for t in texts], pa.list_(pa.int64()))
    rows = pa.StructArray.from_arrays([pa.array(range(len(texts))), codes], ["id", "codes"])
    return bag_blocks.Lists(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows)[0])


def code_of(text):
    kind = {C.DELIMITER_WEIGHT: 0, C.IDENTIFIER_WEIGHT: 1, C.OTHER_WEIGHT: 2}
    return [((hash(t) >> 8) << 2) | kind[weight(t)] for t in text]


def texts(seed, n, longest):
    rnd = random.Random(seed)
    out = [[], ["("], ["ID_3"], ["and"]]
    while len(out) < n:
        names = [f"ID_{k}" for k in range(rnd.choice([2, 30, 400]))]
        base = [rnd.choice(names if rnd.random() < .7 else TOKENS) for _ in range(rnd.choice([1, 20, longest]))]
        out.append(base)
        near = list(base)
        for _ in range(rnd.randrange(5)):
            near[rnd.randint(0, len(near)):rnd.randint(0, len(near))] = [rnd.choice(TOKENS)]
        out.append(near)
    return out[:n]


def plain_common(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for k, y in enumerate(b):
            now.append(last[k] + 1 if x == y else max(last[k + 1], now[k]))
        last = now
    return last[-1]


@pytest.mark.parametrize("few, table, stepped", [(16, 10**8, 4096), (0, 10**8, 7), (10**6, 10**8, 4096), (0, 0, 4096)])
def test_joint_subsequences(monkeypatch, few, table, stepped):
    monkeypatch.setattr(bag_blocks, "FEW", few)
    monkeypatch.setattr(bag_blocks, "TABLE", table)
    monkeypatch.setattr(bag_blocks, "STEPPED", stepped)
    given, other = texts(1, 14, 150), texts(2, 14, 150)
    other[5:8] = given[5:8]
    a, b = block(given), block(other)
    i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    spread = lambda t: np.repeat(np.array(code_of(t), np.int64), copies(np.array(code_of(t), np.int64))).tolist()
    expected = [plain_common(spread(given[x]), spread(other[y])) for x, y in zip(i, j)]
    assert bag_blocks.joint_subsequences(a, b, i, j, True).tolist() == expected
    assert (bag_blocks.joint_subsequences(a, b, i, j, False) >= expected).all()
    assert bag_blocks.joint_subsequences(a, b, i[:0], j[:0], True).tolist() == []


@pytest.mark.parametrize("t", [0.75, 0.9])
def test_no_pair_that_reaches_is_dropped(t):
    given = texts(3, 60, 60)
    a = block(given)
    i, j, _ = bag_blocks.compare(a, a, t, True, True)
    kept = set(zip(i.tolist(), j.tolist()))
    near = {(x, y) for x in range(60) for y in range(x + 1, 60) if given[x] and given[y] and plain_score(given[x], given[y]) >= t - SLACK}
    assert near <= kept and near


def test_classes_that_agree_one_by_one_but_not_together():
    # Names and words stand in the same order each, but the words lie elsewhere among the names.
    names = [f"ID_{k}" for k in range(40)]
    a, b = names[:20] + ["and"] * 10 + names[20:], ["and"] * 10 + names
    left = bag_blocks.compare(block([a]), block([b]), 0.9, False, True)
    assert len(left[0]) == 0 and plain_score(a, b) < 0.9
    assert len(bag_blocks.compare(block([a]), block([b]), 0.6, False, True)[0]) == 1


def test_few_pairs_are_left_to_score(spark):
    """All documents as one job; with a bound for each weight class alone 1.45 % of all pairs of shapes were left."""
    rows = M.shapes(B.prints(spark, SMALL).drop("tokens", "params", "code")).cache()
    sizes = [r["count"] for r in rows.groupBy(*M.KEY).count().collect()]
    n = M.shape_pairs(rows, C.NEAR_MISS_FLOOR, "t").count()
    rows.unpersist()
    assert 0 < n < 0.005 * sum(s * (s - 1) / 2 for s in sizes)
