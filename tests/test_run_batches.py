"""Batches of pairs are scored as pairs are one by one."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tests.test_matching import TOKENS, code
from twinspan.functions import matching as M
from twinspan.functions import run_batches as R


def columns(seed, n=120):
    rnd = random.Random(seed)
    texts = []
    for _ in range(40):
        few = rnd.sample(TOKENS, rnd.choice([1, 2, 5, len(TOKENS)]))
        base = rnd.choices(few, k=rnd.choice([0, 1, 3, 30, 90]))
        texts.append(base)
        near = list(base)
        for _ in range(rnd.choice([1, 3])):
            near[rnd.randint(0, len(near)) : rnd.randint(0, len(near))] = rnd.choices(few, k=rnd.randint(0, 4))
        texts.append(near)
    return texts, [(rnd.randrange(80), rnd.randrange(80)) for _ in range(n)] + [(2 * k, 2 * k + 1) for k in range(40)]


def column(texts, numbers):
    return pa.array([code(texts[k]).codes.tolist() for k in numbers], pa.list_(pa.int64()))


@pytest.mark.parametrize("tokens, places", [(10**6, 10**6), (200, 50)])
@pytest.mark.parametrize("at_least", [0.0, 0.3, 0.75, 0.9])
def test_scores_of_a_batch(monkeypatch, tokens, places, at_least):
    monkeypatch.setattr(R, "TOKENS", tokens)
    monkeypatch.setattr(R, "PLACES", places)
    texts, pairs = columns(7)
    a, b = zip(*pairs)
    names = (pa.array(a), pa.array(b))
    got = M._judged(column(texts, a), column(texts, b), names, lambda c, x, y: M._scores(c, x, y, at_least))
    for (x, y), score in zip(pairs, got):
        expected = M.near_miss_score(code(texts[x]), code(texts[y]), at_least)
        assert (expected is None and np.isnan(score)) or abs(expected - score) < 1e-12


@pytest.mark.parametrize("most", [R.MOST, 0])
def test_ratios_of_a_batch(monkeypatch, most):
    monkeypatch.setattr(R, "MOST", most)
    texts, pairs = columns(11)
    words = [*texts, None, [None, "x", None]]
    pairs += [(80, 0), (80, 80), (81, 81), (1, 81)]
    a, b = (pa.array([words[k] for k in side], pa.list_(pa.string())) for side in zip(*pairs))
    got = M.sequence_ratio.func(a, b).to_pylist()
    assert got == [M.sequence_similarity(words[x] or [], words[y] or []) for x, y in pairs]
    # A slice of a longer column, and no row at all.
    assert M.sequence_ratio.func(a.slice(5), b.slice(5)).to_pylist() == got[5:]
    assert M.sequence_ratio.func(a.slice(0, 0), b.slice(0, 0)).to_pylist() == []


def test_unrelated_texts_cost_less_than_one_by_one():
    rnd = random.Random(3)
    texts = [rnd.choices(TOKENS, k=400) for _ in range(60)]
    a, b = zip(*[(rnd.randrange(60), rnd.randrange(60)) for _ in range(300)])
    began = time.process_time()
    M._judged(column(texts, a), column(texts, b), (pa.array(a), pa.array(b)), lambda c, x, y: M._scores(c, x, y, 0.75))
    batch = time.process_time() - began
    profiles = [code(t) for t in texts]
    began = time.process_time()
    for x, y in zip(a, b):
        M._matched(profiles[x], profiles[y], 0.0)
    assert batch < time.process_time() - began
