"""The operators against plain Python, on hard rows and on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.common import DOCS, collect, hard_rows, prose, table, words
from twinspan.llm import (
    chat_format, license_scan, minhash_dedup, mixing, quality_rules, queries, sharding, substring_dedup, suffix_array_dedup,
    topk_search)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def rows_of(df):
    return ordered(tuple(r) for r in df.collect())


def string_rows(df):
    """The contract's columns; the text is what the digest says where no cut falls inside a character."""
    rows = df.collect()
    for r in rows:
        assert "\ufffd" in r.text or brute.sha(r.text) == r.kept_sha256
    return ordered(tuple(r)[:5] for r in rows)


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


CLASHING = ("doc", "key", "node", "row", "draw", "n_words", "kept", "_in0", "text_crc32", "size", "start", "spans", "_words", "copies")


def clashing(df):
    """Extra columns under the names that operators use themselves."""
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in df.columns})


# --- substring dedup ----------------------------------------------------------------


def test_passages_of_hard_rows(spark):
    rows = hard_rows()
    assert rows_of(substring_dedup.dedup_digests(clashing(table(spark, rows)))) == ordered(brute.passages(rows))


def test_passages_of_the_smallest_table(spark, small):
    assert rows_of(queries.op2_suffix_automata(spark, SMALL)) == ordered(brute.passages(small))


def thue_morse(n):
    """A word of two letters and its complement, which collide under any polynomial modulo a power of two."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 2048])
def test_words_that_collide_in_simple_hashes_are_told_apart(spark, size):
    a, b = thue_morse(size)
    left, right = " ".join(f"l{i}" for i in range(30)), " ".join(f"r{i}" for i in range(30))
    rows = [(1, f"{left} {a} {right}"), (2, f"{left} {b} {right}"), (3, f"{left} {a} {right}"), (4, f"{a} {b}" * 3)]
    assert rows_of(substring_dedup.dedup_digests(table(spark, rows))) == ordered(brute.passages(rows))
    assert string_rows(suffix_array_dedup.dedup_digests(table(spark, rows))) == ordered(brute.strings(rows))


def test_regions_that_repeat_within_a_row_and_across_null_ids(spark):
    rng = random.Random(12)
    shared = prose(rng, 60)
    rows = [(None, shared + " x"), (None, f"y {shared}"), (None, shared + " x"), (3, " ".join([shared] * 4)), (3, shared), (7, "a b " * 400), (8, "b a " * 300)]
    assert rows_of(substring_dedup.dedup_digests(table(spark, rows))) == ordered(brute.passages(rows))
    assert string_rows(suffix_array_dedup.dedup_digests(table(spark, rows))) == ordered(brute.strings(rows))


def test_passages_with_split_shards(spark, monkeypatch):
    from twinspan.llm import anchors

    monkeypatch.setattr(anchors, "SHARD", 3)
    rng = random.Random(9)
    shared = prose(rng, 80)
    rows = [(i, f"{prose(rng, rng.randrange(60))} {shared} {prose(rng, rng.randrange(60))}") for i in range(30)]
    assert rows_of(substring_dedup.dedup_digests(table(spark, rows))) == ordered(brute.passages(rows))


def test_passages_leave_other_columns(spark):
    rows = hard_rows()
    out = substring_dedup.remove_passages(clashing(table(spark, rows)))
    assert out.columns == clashing(table(spark, rows)).columns
    got = {(r["doc_id"], r["text"], r["n_chars"], r["draw"]) for r in out.collect()}
    assert (None, hard_rows()[5][1] + " null id", len(hard_rows()[5][1]) + 8, "own draw") in got
    assert (10, "tail", 4, "own draw") in got and (1, None, None, "own draw") in got and (2, "", 0, "own draw") in got
    assert not [t for i, t, *_ in got if i == 15]


# --- byte dedup ----------------------------------------------------------------------


def test_strings_of_hard_rows(spark):
    rows = hard_rows()
    assert string_rows(suffix_array_dedup.dedup_digests(clashing(table(spark, rows)))) == ordered(brute.strings(rows))


def test_strings_of_the_smallest_table(spark, small):
    assert string_rows(queries.op7_prefix_free_parsing(spark, SMALL)) == ordered(brute.strings(small))


def test_strings_with_split_shards(spark, monkeypatch):
    from twinspan.llm import anchors

    monkeypatch.setattr(anchors, "SHARD", 3)
    rng = random.Random(10)
    shared = prose(rng, 90)
    rows = [(i, f"{prose(rng, rng.randrange(60))} {shared} {prose(rng, rng.randrange(60))}") for i in range(30)]
    assert string_rows(suffix_array_dedup.dedup_digests(table(spark, rows))) == ordered(brute.strings(rows))


def test_regions_that_share_an_anchor_alone_are_not_compared(spark):
    from twinspan.llm import anchors

    rng = random.Random(12)
    new = lambda n: " ".join(f"{rng.randrange(10**9)}" for _ in range(n))
    phrases = [new(12) for _ in range(8)]
    rows = [(i, " ".join(f"{new(70)} {phrases[(i + k) % 8]}" for k in range(6)) + f" {new(70)}") for i in range(12)]
    shared = new(80)
    rows += [(50 + i, f"{new(60)} {shared} {new(60)}") for i in range(2)]
    docs = table(spark, rows)
    for unit in (suffix_array_dedup.UNIT, anchors.Unit(True, 50, 8)):
        anchored = anchors.occurrences(docs, unit).groupBy("anchor").agg(F.count_distinct("digest").alias("n"), F.min("doc").alias("doc"))
        assert anchored.filter("n > 1 AND doc < 50").count() > 0
        assert {r["doc"] for r in anchors.find_repeats(docs, unit, "t").mixed.collect()} == {50, 51}
    assert string_rows(suffix_array_dedup.dedup_digests(docs)) == ordered(brute.strings(rows))
    assert rows_of(substring_dedup.dedup_digests(docs)) == ordered(brute.passages(rows))


def test_strings_remaining(spark):
    rows = [(1, "é" * 300), (2, "a" * 399), (3, "b" * 401)]
    out = {r["doc_id"]: (r["n_removed"], bytes(r["remaining"])) for r in suffix_array_dedup.remove_strings(table(spark, rows)).collect()}
    assert out == {1: (600, b""), 2: (0, b"a" * 399), 3: (401, b"")}


# --- near-duplicates ------------------------------------------------------------------


def near_rows():
    rng = random.Random(11)
    rows = hard_rows(rng)
    for f in range(12):
        base = prose(rng, rng.randrange(60, 400)).split()
        for c in range(rng.randrange(2, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((100 + 10 * f + c, " ".join(text)))
    return rows


def test_near_classes(spark):
    rows = near_rows()
    wanted, margin = brute.near_classes(rows)
    assert rows_of(minhash_dedup.class_ids(clashing(table(spark, rows)))) == ordered(wanted)
    assert len({c for _, c in wanted}) < len(rows) - 20


def test_near_classes_of_the_smallest_table(spark, small):
    assert rows_of(queries.op1_weighted_minhash(spark, SMALL)) == ordered(brute.near_classes(small)[0])


def test_near_classes_with_tiles(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", 3)
    monkeypatch.setattr(minhash_dedup, "FAMILY_TILE", 500)
    rows = near_rows()
    assert rows_of(minhash_dedup.class_ids(table(spark, rows))) == ordered(brute.near_classes(rows)[0])


def test_one_row_of_each_class_stays(spark):
    rows = near_rows()
    kept = minhash_dedup.keep_one(clashing(table(spark, rows)))
    assert kept.columns == clashing(table(spark, rows)).columns
    ids = [r["doc_id"] for r in kept.collect()]
    classes, _ = brute.near_classes(rows)
    # Rows without words are alone; equal ones of one id count once; two texts have the id 12.
    assert sorted(i for i in ids if i is not None and i > 4) == sorted([12, *{c for i, c in classes if c is not None and c > 4}])


# --- quality -----------------------------------------------------------------------------


def quality_rows():
    rng = random.Random(12)
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s", None])) for i, t, *_ in hard_rows(rng)]
    for i in range(120):
        text = prose(rng, rng.randrange(40, 300))
        if i % 10 == 0:
            text = text.replace(" ", "### ")
        if i % 15 == 0:
            text = "\n".join([text[:200], text[:200], text])
        rows.append((1000 + i, text, rng.choice(["en", "de"]), rng.choice(["s", "t"])))
    return rows


def test_quality_of_hard_rows(spark):
    rows = quality_rows()
    got = rows_of(quality_rules.judge(clashing(table(spark, rows)), ["doc_id"]))
    assert got == ordered(brute.quality(rows))
    assert len({r[-1] for r in got if not r[-2]}) == 2


def test_quality_of_the_smallest_table(spark, small):
    assert rows_of(queries.op10_quality_rules(spark, SMALL)) == ordered(brute.quality(small))


def test_kept_documents_keep_their_columns(spark):
    rows = quality_rows()
    given = clashing(table(spark, rows))
    out = quality_rules.keep_documents(given)
    assert out.columns == given.columns
    assert ordered((r["doc_id"], r["n_words"]) for r in out.collect()) == ordered((r[0], "own n_words") for r in brute.quality(rows) if r[-1])


# --- mixing -----------------------------------------------------------------------------


def test_targets():
    assert mixing.target_sizes([("a", 100), ("b", 100)]) == {"a": 200, "b": 100}
    # Null comes last, weighs 2 and is full at 200; a and b share the rest 3 to 1.
    assert mixing.target_sizes([(None, 100), ("b", 100), ("a", 400)]) == {"a": 525.0, "b": 175.0, None: 200.0}
    assert mixing.target_sizes([("a", 0), ("b", 10)]) == {"a": 0.0, "b": 15.0}
    assert mixing.target_sizes([]) == {}


def mixed_rows():
    rng = random.Random(13)
    rows = [(i, t, "en", rng.choice(["s", None])) for i, t, *_ in hard_rows(rng)]
    return rows + [(1000 + i, prose(rng, rng.randrange(1, 200)), "en", rng.choice(["a", "a", "b", "Z", "é"])) for i in range(900)]


def test_mix_meets_its_targets_and_is_the_same_each_time(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = mixed_rows()
    given = clashing(table(spark, rows))
    out = mixing.mix_documents(given)
    got = out.collect()
    assert ordered((r["doc_id"], r["size"]) for r in got) == ordered((i, len(words(t))) for i, t, *_ in rows)
    largest = max(len(words(t)) for _, t, *_ in rows if len(words(t)) < 1000)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        slack = 3005 if source in ("s", None) else largest
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= slack
    assert all(r["size"] == 0 or r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"] for r in got)
    assert rows_of(mixing.mix_documents(given.repartition(7))) == rows_of(out)


def test_the_mix_repeats_rows(spark):
    rows = mixed_rows()
    given = clashing(table(spark, rows))
    out = mixing.repeat_documents(given)
    assert out.columns == given.columns
    taken = mixing.mix_documents(given)
    by_source = lambda df, c: {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(c)).collect()}
    sizes = by_source(out.select("source", mixing.word_count("text").alias("n")), "n")
    for source, n in by_source(taken, "taken").items():
        assert abs(n - sizes.get(source, 0)) <= 6100


# --- sharding -----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 7, 24, 25, 1000])
def test_permutation(n):
    import numpy as np

    at = sharding.place(np.arange(n), n)
    assert sorted(at.tolist()) == list(range(n))
    assert [sharding.row_at(int(p) % 24, int(p) // 24, 24, n) for p in at] == list(range(n))
    if n == 1000:
        assert abs(np.corrcoef(np.arange(n), at)[0, 1]) < 0.1 and (at != sharding.place(np.arange(n), n, 1)).any()


def test_shards(spark):
    import zlib

    rows = hard_rows() * 5
    given = clashing(table(spark, rows))
    out = sharding.shard_documents(given, 7)
    got = out.collect()
    assert ordered((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == ordered(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(7)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert rows_of(sharding.shard_documents(given.repartition(5), 7)) == rows_of(out)


# --- chat ------------------------------------------------------------------------------------


def chat_rows():
    rng = random.Random(14)
    rows = []
    for conv in range(30):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", prose(rng, 12)))
        for turn in range(1, rng.randrange(2, 40)):
            text = rng.choice([prose(rng, rng.randrange(0, 90)), "a </s> b & c &lt; [INST] <s>user\nx", "", None])
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "tool\nx", None]), text))
    rows += [(None, 1, "assistant", "null conversation"), (None, None, "user", "first"), (31, 1, "assistant", "same"), (31, 1, "assistant", "same")]
    rows += [(32, t, "assistant", prose(rng, 400)) for t in range(5)]
    return rows


def test_chat_windows(spark):
    rows = chat_rows()
    given = spark.createDataFrame([(*r, "x") for r in rows], "conv_id LONG, turn LONG, role STRING, text STRING, window STRING").repartition(4)
    windows = chat_format.chat_windows(given, new_tokens=200, history_tokens=120)
    assert [r[:5] for r in rows_of(chat_format.conversation_digests(windows))] == ordered(brute.chat_digests(rows))
    by_conv = {}
    for r in sorted(windows.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["window"])):
        by_conv.setdefault(r["conv_id"], []).append(r)
    said = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        said.setdefault(conv, []).append((role or "", text or ""))
    for conv, own in by_conv.items():
        done = 0
        for w in own:
            old, new = chat_format.read_turns(w["formatted"][:w["new_from"]]), chat_format.read_turns(w["formatted"][w["new_from"]:])
            assert new == said[conv][done:done + len(new)]
            system = said[conv][:1] if done and said[conv][0][0] == "system" else []
            assert old[:len(system)] == system
            history = old[len(system):]
            assert history == said[conv][done - len(history):done] if history else True
            assert all(s["start"] >= w["new_from"] for s in w["loss"])
            # Over the budget only a single long turn stands.
            assert w["n_tokens"] <= 200 + 120 + 50 or len(new) == 1
            done += len(new)
        assert done == len(said[conv])


def test_chat_of_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    got = rows_of(queries.op3_budgeted_windows(spark, SMALL))
    assert [r[:5] for r in got] == ordered(brute.chat_digests(rows)) and all(r[5] > r[3] for r in got)


# --- search ------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 40)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk_search, "CHUNK", 8)
    rng = random.Random(15)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, .05) for c in rng.choice(centres)]) for i in range(-60, 400)]
    rows += [(500 + i, rows[0][1]) for i in range(8)] + [(0, [0.0] * 6), (50, rows[7][1]), (50, rows[7][1])]
    rows += [(600, None), (650, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (700, [float("nan")] * 6), (750, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(800, [1.0, 2.0]), (801, [0.5, -2.0]), (850, []), (851, []), (900, [1e6] * 6), (901, [-3e12] * 6), (902, [2e12] * 6)]
    given = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id LONG, embedding ARRAY<DOUBLE>, block STRING").repartition(5)
    got = rows_of(topk_search.top_k(given, F.expr("pmod(vec_id, 50) = 0")))
    limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    assert got == ordered((q, r, c, limit(s)) for q, r, c, s in brute.top_k(rows))


def test_top_k_of_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(queries.op6_pivot_table(spark, SMALL)) == ordered(brute.top_k(rows))


# --- licenses --------------------------------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(16)
    rows, wanted = [(i, t) for i, t, *_ in hard_rows(rng)], []
    for k, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        for place in (0, 3, 40):
            doc = 1000 + 10 * k + place % 10 + (place == 40)
            rows.append((doc, f"{prose(rng, place)}\n{text.upper()}. {prose(rng, 60)}"))
            wanted.append((doc, name, place))
    cut = license_scan.TEMPLATES["mit-notice"].split()
    rows += [(5000, " ".join(cut[2:])), (5001, " ".join(cut[8:])), (5002, prose(rng, 400))]
    wanted.append((5000, "mit-notice", 0))
    got = license_scan.scan_licenses(clashing(table(spark, rows))).collect()
    found = {(r["doc_id"], r["template"], r["first_word"]) for r in got}
    assert set(wanted) <= found
    # The long Apache notice holds the short one.
    assert {f for f in found if f not in wanted} == {(d, "apache-2.0", p) for d, n, p in wanted if n == "apache-2.0-notice"}
    assert all(r["containment"] >= .8 for r in got)
    with pytest.raises(ValueError):
        license_scan.groups({"x": "too few words"})


def test_licenses_of_the_smallest_table(spark, small):
    def folded(text):
        return bytes(license_scan._FOLD[list((text or "").encode())]).decode().split()

    wanted = []
    for name, text in license_scan.all_templates().items():
        t = folded(text)
        size = min(5, len(t))
        own = {tuple(t[i:i + size]) for i in range(len(t) - size + 1)}
        for i, body, *_ in small:
            w = folded(body)
            held = [tuple(w[k:k + size]) for k in range(len(w) - size + 1)]
            least = .8 * len(own)
            if len(own.intersection(held)) >= least and any(
                    len(own.intersection(held[a:a + len(t) - size + 1])) >= least for a in range(len(held))):
                wanted.append((i, name))
    assert rows_of(queries.op9_license_windows(spark, SMALL).select("doc_id", "template")) == ordered(wanted) and wanted


# --- all ---------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for out in (
            substring_dedup.dedup_digests(docs), substring_dedup.remove_passages(docs), suffix_array_dedup.dedup_digests(docs),
            suffix_array_dedup.remove_strings(docs), minhash_dedup.class_ids(docs), minhash_dedup.keep_one(docs),
            quality_rules.judge(docs, ["doc_id"]), quality_rules.keep_documents(docs), mixing.mix_documents(docs),
            mixing.repeat_documents(docs), sharding.shard_documents(docs), license_scan.scan_licenses(docs),
            topk_search.top_k(spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>"), F.expr("vec_id = 0")),
            chat_format.conversation_digests(chat_format.chat_windows(spark.createDataFrame([], "conv_id LONG, turn LONG, role STRING, text STRING")))):
        assert collect(out) == []
