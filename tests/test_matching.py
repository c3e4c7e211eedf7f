"""Exact scores and lossless bounds, against difflib and brute force."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from twinspan import constants as C
from twinspan.functions import matching as M
from twinspan.functions.renaming import rename_batch

TOKENS = ["(", ")", ";", "{", "ID_0", "ID_1", "ID_2", "ID_9", "return", "+", "=", "1", "2", '"x"']
lists = st.lists(st.sampled_from(TOKENS), min_size=0, max_size=40)


def code(tokens):
    number = {t: i for i, t in enumerate(TOKENS)}
    kind = {C.DELIMITER_WEIGHT: 0, C.IDENTIFIER_WEIGHT: 1, C.OTHER_WEIGHT: 2}
    return M.Profile(np.array([(number[t] << 2) | kind[M.weight(t)] for t in tokens], dtype=np.int64))


def plain_score(a, b):
    total = sum(map(M.weight, a)) + sum(map(M.weight, b))
    if not total:
        return 0.0

    def one_way(x, y):
        blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        return sum(M.weight(x[i + k]) for i, _, n in blocks for k in range(n))

    return 2 * min(one_way(a, b), one_way(b, a)) / total


@settings(max_examples=300, deadline=None)
@given(lists, lists)
def test_ratio_equals_difflib(a, b):
    expected = SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0
    assert abs(M.sequence_similarity(a, b) - expected) < 1e-12


@settings(max_examples=300, deadline=None)
@given(lists, lists)
def test_score_is_exact_and_symmetric(a, b):
    score = M.near_miss_score(code(a), code(b))
    assert abs(score - plain_score(a, b)) < 1e-12
    assert score == M.near_miss_score(code(b), code(a))


@settings(max_examples=300, deadline=None)
@given(lists, lists, st.sampled_from([0.3, 0.75, 0.9]))
def test_cut_off_drops_only_lower_scores(a, b, t):
    full, cut = plain_score(a, b), M.near_miss_score(code(a), code(b), t)
    if full >= t:
        assert abs(cut - full) < 1e-12
    else:
        assert cut is None


@settings(max_examples=200, deadline=None)
@given(lists, lists)
def test_bound_is_an_upper_bound(a, b):
    total = sum(map(M.weight, a)) + sum(map(M.weight, b))
    bound = M.matched_weight_bound(code(a), code(b), 0)
    assert bound + 1e-9 >= plain_score(a, b) * total / 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "x1", "if", "1", "'s'", "(", "_"]), max_size=15), max_size=6))
def test_batch_renaming_is_first_seen_order(batch):
    got = rename_batch(pa.array(batch, pa.list_(pa.string()))).to_pylist() if batch else []
    for tokens, renamed in itertools.zip_longest(batch, got):
        names = {}
        expected = []
        for t in tokens:
            if t in C.KEYWORDS or t == "(":
                expected.append(t)
            elif t[0] in "1'":
                expected.append("LITERAL")
            else:
                expected.append(f"ID_{names.setdefault(t, len(names))}")
        assert renamed == expected


def test_renaming_in_slices(monkeypatch):
    from twinspan.functions import renaming

    rows = [["a", "b", "a", "1"], [], None, ["b"] * 9, ["return", "x", "y", "x"], ["y"]]
    lists = pa.array([["z"], *rows], pa.list_(pa.string())).slice(1)
    whole = renaming.rename_batch(lists).to_pylist()
    seen = []
    once = renaming._rename
    monkeypatch.setattr(renaming, "TOKENS", 4)
    monkeypatch.setattr(renaming, "_rename", lambda part: seen.append(len(part.flatten())) or once(part))
    assert renaming.rename_batch(lists).to_pylist() == whole
    assert whole == [["ID_0", "ID_1", "ID_0", "LITERAL"], [], [], ["ID_0"] * 9, ["return", "ID_0", "ID_1", "ID_0"], ["ID_0"]]
    assert sorted(seen)[-1] == 9 and len(seen) == 4 and sum(seen) == 18
    assert renaming.rename_batch(lists.slice(0, 0)).to_pylist() == []


def test_row_slices_hold_about_so_many_elements():
    from twinspan.functions.renaming import row_slices

    lists = pa.array([[1] * n for n in (3, 0, 2, 9, 1, 1, 4)], pa.list_(pa.int32()))
    assert row_slices(lists, 5) == [(0, 3), (3, 4), (4, 6), (6, 7)]
    assert row_slices(lists.slice(3), 5) == [(0, 1), (1, 3), (3, 4)]
    assert row_slices(lists.slice(0, 0), 5) == []
