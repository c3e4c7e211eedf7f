"""Bodies, notices and phrases of the license table."""

import random

import pytest

from tests.conftest import SMALL
from tests.llm.common import prose, table
from twinspan.llm import license_scan, queries


def folded(text):
    return bytes(license_scan._FOLD[list((text or "").encode())]).decode().split()


def contained(words, own):
    """Whether some window of the template's length holds 0.8 of its shingles."""
    size = min(5, len(own))
    wanted = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}
    grams = [tuple(words[k:k + size]) for k in range(len(words) - size + 1)]
    hits = [k for k, g in enumerate(grams) if g in wanted]
    return any(
        len({grams[j] for j in hits if k <= j <= k + len(own) - size}) >= .8 * len(wanted) for k in hits)


def test_the_usual_licenses_are_covered():
    names = set(license_scan.all_templates())
    wanted = "apache bsd-2 bsd-3 mit isc gpl-2 gpl-3 lgpl-2 lgpl-3 agpl mpl epl unlicense cc0 proprietary all-rights".split()
    assert [w for w in wanted if not any(n.startswith(w) for n in names)] == []


def test_every_template_is_found_in_full_and_in_part(spark):
    rng = random.Random(51)
    texts = license_scan.all_templates()
    rows = [(i, f"{prose(rng, 7)}\n{t.upper()}\n{prose(rng, 40)}") for i, t in enumerate(texts.values())]
    mit = texts["mit-body"].split()
    rows += [(900, " ".join(mit[27:])), (901, " ".join(mit[80:])), (902, "all rights. reserved"), (903, "all the rights reserved"), (904, "ALL RIGHTS")]
    got = {(r["doc_id"], r["template"]): r for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    for i, name in enumerate(texts):
        assert got[i, name]["containment"] == 1.0 and got[i, name]["first_word"] == 7
    assert (900, "mit-body") in got and (900, "mit-notice") not in got
    assert {k for k in got if k[0] > 900} == {(902, "all-rights-reserved")} and got[902, "all-rights-reserved"]["first_word"] == 0


def test_short_and_empty_templates(spark):
    rows = [(1, "x a b a b"), (2, "a"), (3, None), (4, "a, B!")]
    got = license_scan.scan_licenses(table(spark, rows), {"two": "A b", "one": "a"}).collect()
    assert sorted(map(tuple, got)) == [(1, "one", 1.0, 1), (1, "two", 1.0, 1), (2, "one", 1.0, 0), (4, "one", 1.0, 0), (4, "two", 1.0, 0)]
    with pytest.raises(ValueError):
        license_scan.phrases({"none": "..."})


def test_the_smallest_table_by_all_templates(spark):
    docs = [(r["doc_id"], folded(r["text"])) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    wanted = [(i, name) for name, text in license_scan.all_templates().items() for i, w in docs if contained(w, folded(text))]
    got = [(r["doc_id"], r["template"]) for r in queries.op9_license_windows(spark, SMALL).collect()]
    assert sorted(got) == sorted(wanted)
    assert sum(name == "all-rights-reserved" for _, name in got) == 3
