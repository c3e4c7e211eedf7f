"""A document that is extreme in one statistic alone is rejected, clean ones stay."""

import random

from tests.llm.common import prose, table
from twinspan.llm import quality_rules


def lines_of(rng, n, width=10):
    return [prose(rng, width) for _ in range(n)]


def extreme_rows(rng):
    """One document per statistic that passes the base rules and differs in hardly anything else."""
    lines = lines_of(rng, 30)
    twice = " ".join(lines[:10])
    return {
        "n_words": (2001, "\n".join(lines_of(rng, 9000))),
        "word_chars": (2002, "\n".join(" ".join(w * 3 for w in x.split()) for x in lines)),
        "n_symbols": (2003, "\n".join(x.replace("w", "#") for x in lines)),
        # Two-word lines whose triples differ from line to line.
        "n_dup_lines": (2004, "\n".join([*lines, *(x for k in range(40) for x in (f"again here{k // 20}", prose(rng, 2)))])),
        # Nearly half the words stand twice, in lines of their own cut.
        "n_repeat_words": (2005, "\n".join([*(" ".join(twice.split()[i:i + 10]) for i in range(0, 70, 10)),
                                            *(" ".join(twice.split()[i:i + 11]) for i in range(0, 70, 11)), *lines_of(rng, 16)])),
    }


def clean_rows(rng):
    rows = []
    for i in range(400):
        lines = lines_of(rng, rng.randrange(15, 60))
        if i % 40 == 0:
            lines.append(lines[3])
        if i % 50 == 0:
            lines[5] += " #1 * a"
        rows.append((i, "\n".join(lines)))
    return rows


def test_each_statistic_alone_rejects(spark):
    rng = random.Random(31)
    extreme, clean = extreme_rows(rng), clean_rows(rng)
    got = {r["doc_id"]: r for r in quality_rules.judge(table(spark, [*clean, *extreme.values()]), ["doc_id"]).collect()}
    assert not any(got[i]["base_failed"] for i, _ in extreme.values())
    assert [name for name, (i, _) in extreme.items() if got[i]["kept"]] == []
    assert [i for i, _ in clean if not got[i]["kept"]] == []


def test_no_floor_keeps_a_statistic_from_rejecting():
    """What a statistic reaches at most, past the base rules, over its floor."""
    assert (2.398 / quality_rules.FLOORS[3]) ** 2 > quality_rules.CUTOFF
    assert 0.5 / quality_rules.FLOORS[4] ** 2 > quality_rules.CUTOFF
