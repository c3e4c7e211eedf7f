import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import words
from twinspan.llm import anchors, suffix_array_dedup, symbols
from twinspan.llm.substring_dedup import SuffixAutomaton

TEXTS = ["a b  c", "", None, " x\ny\tz\x0b\x0c\r", "日本 é", "   ", "one", "  　 w"]


def block(texts):
    return symbols.text_buffers(pa.array(texts, pa.string()))


def test_words_are_runs_between_ascii_spaces():
    data, offsets = block(TEXTS)
    starts, ends, rows = symbols.word_spans(data, offsets)
    found = [[bytes(data[starts[i]:ends[i]]).decode() for i in range(a, b)] for a, b in zip(rows[:-1], rows[1:])]
    assert found == [words(t) for t in TEXTS]


def test_a_slice_of_a_column_reads_its_own_rows():
    data, offsets = symbols.text_buffers(pa.array(["aa", "b", None, "cc"])[1:])
    assert bytes(data) == b"bcc" and offsets.tolist() == [0, 1, 1, 3]
    assert [len(x) for x in symbols.text_buffers(pa.array([], pa.string()))] == [0, 1]


def test_equal_words_have_equal_hashes_in_long_texts_too(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 4) for _ in range(500)) for _ in range(4)] + ["x" * 900]
    data, offsets = block(texts)
    whole, rows = symbols.word_hashes(data, offsets)
    monkeypatch.setattr(symbols, "BLOCK", 64)
    pieces, again = symbols.word_hashes(data, offsets)
    assert (whole == pieces).all() and (rows == again).all()
    named = {}
    for h, w in zip(whole.tolist(), [w for t in texts for w in words(t)], strict=True):
        assert named.setdefault(h, w) == w
    assert len(named) == len({w for t in texts for w in words(t)})


def test_blocks_hold_whole_rows():
    offsets = np.array([0, 3, 3, 10, 30, 31])
    assert list(symbols.blocks(offsets, 10)) == [(0, 3), (3, 4), (4, 5)]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 43, 64, 200])
def test_sliding_min(width):
    values = np.random.default_rng(width).integers(0, 50, 200)
    assert (symbols.sliding_min(values, width) == [values[i:i + width].min() for i in range(201 - width)]).all()


@pytest.mark.parametrize("words_unit", [True, False])
def test_regions_hold_each_window_once(words_unit, monkeypatch):
    rng = random.Random(2)
    unit = anchors.Unit(words_unit, 12, 4)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 5, 11, 12, 13, 90, 300)]
    symbols_ = unit.symbols(*block(texts))
    values, offsets = symbols_.values, symbols_.offsets
    whole = list(anchors.pieces(values, offsets, unit))
    monkeypatch.setattr(anchors, "BLOCK", 4)
    for found in (whole, list(anchors.pieces(values, offsets, unit))):
        seen = sorted((int(r), int(s) + k) for row, start, n, *_ in found for r, s, m in zip(row, start, n) for k in range(m))
        assert seen == [(r, k) for r, size in enumerate(np.diff(offsets)) for k in range(max(0, size - 11))]


def test_equal_windows_share_an_anchor():
    rng = random.Random(3)
    unit = anchors.Unit(True, 50, 8)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(50))
    texts = [f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(rng.randrange(80)))} {shared} {' '.join(f'v{rng.randrange(10**6)}' for _ in range(rng.randrange(80)))}" for _ in range(40)]
    symbols_ = unit.symbols(*block(texts))
    values, offsets = symbols_.values, symbols_.offsets
    row, start, n, anchor = anchors.regions(values, offsets, unit)
    at = [words(t).index(shared.split()[0]) for t in texts]
    assert len({int(a) for r, s, m, a in zip(row, start, n, anchor) if s <= at[r] < s + m}) == 1


def test_suffix_automaton_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        least, letters = rng.choice([2, 3, 5]), rng.choice([2, 3, 6])
        texts = [[rng.randrange(letters) for _ in range(rng.randint(0, 30))] for _ in range(6)]
        numbers = sorted(rng.randrange(4) for _ in texts)
        automaton, first = SuffixAutomaton(), {}
        for t, n in zip(texts, numbers, strict=True):
            automaton.add(t, n)
            for i in range(len(t) - least + 1):
                first.setdefault(tuple(t[i:i + least]), n)
        for n in range(5):
            probe = rng.choice([*texts, [rng.randrange(letters) for _ in range(30)]])
            found = {k for a, b in automaton.matches(probe, n, least) for k in range(a, b)}
            wanted = {k for i in range(len(probe) - least + 1) if first.get(tuple(probe[i:i + least]), n) < n for k in range(i, i + least)}
            assert found == wanted


def test_parsing_gives_the_suffix_order_and_the_repeated_starts():
    rng = random.Random(5)
    for trial in range(120):
        length, letters = rng.choice([5, 20, 40]), "ab" if trial % 2 else "abcdefghij"
        base = "".join(rng.choice(letters) for _ in range(300))
        texts = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randrange(250)
            texts.append(base[a:a + rng.randint(0, 150)] + rng.choice(["", "a" * 100, "".join(rng.choice(letters) for _ in range(60))]))
        data, offsets = block(texts)
        row, at = suffix_array_dedup.repeated_starts(data, offsets, length)
        strings = [(k, i, t[i:i + length]) for k, t in enumerate(texts) for i in range(len(t) - length + 1)]
        several = [s for *_, s in strings]
        assert sorted(zip(row.tolist(), at.tolist())) == [(k, i) for k, i, s in strings if several.count(s) > 1]
        if len(data):
            keys = suffix_array_dedup.Parsing(data, offsets).order_keys(np.arange(len(data)))
            suffixes = [t[i:] for t in texts for i in range(len(t))]
            assert [suffixes[i] for i in np.argsort(keys, kind="stable")] == sorted(suffixes)


def test_merged_spans():
    row, start, end = (np.array(x) for x in ([0, 0, 0, 2], [1, 4, 9, 0], [4, 6, 12, 2]))
    assert [x.tolist() for x in anchors.merged(row, start, end)] == [[0, 0, 2], [1, 9, 0], [6, 12, 2]]
