"""Regions of an anchor that very many share are told window by window, in work that grows with their number."""

import random

import pytest

from twinspan.llm import anchors, suffix_array_dedup

PASSAGE = "".join(random.Random(1).choice("abcdefghij klmno") for _ in range(460))


def texts(n):
    """A long passage between texts that differ, one of them twice; more passages are cut short of a window."""
    rnd = random.Random(2)
    own = lambda k: "".join(rnd.choice("pqrstuvwxyz ") for _ in range(k))
    rows = [own(300) + PASSAGE + own(300) for _ in range(n)] + [own(300) + PASSAGE[:390] + own(300) for _ in range(n)]
    return [(k, t) for k, t in enumerate([*rows, rows[0], own(200) + PASSAGE[20:450] + own(10) + PASSAGE[:405]])]


def brute(rows):
    """Bytes of each row that a string of 400 bytes found elsewhere covers."""
    seen, out = {}, {}
    for k, t in rows:
        for a in range(len(t) - 399):
            seen.setdefault(t[a:a + 400], []).append((k, a))
    for places in seen.values():
        if len(places) > 1:
            for k, a in places:
                out.setdefault(k, set()).update(range(a, a + 400))
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("shard", [3, 2048])
def test_hot_anchors_give_the_same(spark, monkeypatch, shard):
    monkeypatch.setattr(anchors, "SHARD", shard)
    monkeypatch.setattr(anchors, "WINDOWS", 50)
    rows = texts(9)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: r.n_removed for r in suffix_array_dedup.dedup_digests(docs).collect() if r.n_removed}
    assert got == brute(rows) and got


def test_no_region_of_a_hot_anchor_meets_all_others(spark, monkeypatch):
    """With shards, all regions of the anchor were streamed past each shard."""
    monkeypatch.setattr(anchors, "SHARD", 3)
    written, stage = {}, anchors.stage
    monkeypatch.setattr(anchors, "stage", lambda df, name, *rest: written.setdefault(name, stage(df, name, *rest)))
    for n in (8, 16):
        written.clear()
        docs = spark.createDataFrame(texts(n), "doc_id LONG, text STRING")
        suffix_array_dedup.repeated_spans(docs).count()
        assert written["strings-hot"].count() > 0
        hot = written["strings-contents"].join(written["strings-hot"], "anchor", "left_semi").selectExpr("sum(length(content) - 399)").first()[0]
        assert written["strings-windows"].count() == hot
