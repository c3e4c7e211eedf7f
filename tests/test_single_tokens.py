"""Places where single tokens agree are walked over, not formed."""

import random

import numpy as np
import pytest

from twinspan.functions import matching as M
from twinspan.functions import run_batches as R


def batch(texts, pairs):
    codes = np.concatenate([np.array(t, np.int64) for t in texts])
    ends = np.append(0, np.cumsum([len(t) for t in texts]))
    tokens = R.Tokens(codes, M.CLASS_WEIGHTS[codes & 3])
    a, b = (np.array([(ends[p[k]], ends[p[k] + 1]) for p in pairs]) for k in (0, 1))
    return codes, tokens, a, b


def one_by_one(codes, tokens, a, b):
    cut = lambda x: (codes[x[0]:x[1]], tokens.sums[x[0]:x[1] + 1] - tokens.sums[x[0]])
    out = []
    for x, y in zip(a, b):
        (u, su), (v, sv) = cut(x), cut(y)
        out.append(M.matched_weight(u, v, su, sv))
    return out


@pytest.mark.parametrize("n_tokens, longest", [(3, 40), (12, 120), (60, 300)])
def test_weights_of_texts_with_few_tokens(n_tokens, longest):
    rnd = random.Random(n_tokens)
    texts = [[rnd.randrange(n_tokens) * 4 + rnd.randrange(3) for _ in range(rnd.randrange(longest))] for _ in range(12)]
    given = batch(texts, [(x, y) for x in range(12) for y in range(12)])
    got = R.matched_weights(given[1], *given[2:], np.zeros(144))
    assert got.tolist() == one_by_one(*given)


def test_single_tokens_are_not_formed(monkeypatch):
    # Blocks of one token against turns of all tokens: 18 times 60 x 60 single places agree, and no two in a row.
    texts = [[k * 4 + 1 for k in range(18) for _ in range(60)], [k * 4 + 1 for _ in range(60) for k in range(17, -1, -1)]]
    given = batch(texts, [(0, 1), (1, 0)])
    formed = []
    split = R._split
    monkeypatch.setattr(R, "_split", lambda tokens, parts, runs, *rest: formed.append(len(runs[0])) or split(tokens, parts, runs, *rest))
    assert R.matched_weights(given[1], *given[2:], np.zeros(2)).tolist() == one_by_one(*given)
    assert sum(formed) == 0
