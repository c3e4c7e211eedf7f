"""Collocations against counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.common import hard_rows, table
from twinspan.llm import collocations, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support=30, shown=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        dropped = set()
        for p, b in found.items():
            for z in range(2, len(p)):
                for s in range(len(p) - z + 1):
                    if 100 * b >= 80 * counts[p[s:s + z]]:
                        dropped.add(p[s:s + z])
        rows_ = []
        for p, a in found.items():
            if p in dropped:
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], score))
        rows_.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (p, a, l, r, s) in enumerate(rows_[:shown], 1)]
    return sorted(out)


def lines(rng, n, vocabulary=40):
    w = [f"W{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join(x + rng.choice([" "] * 8 + [", ", ".\n", "\t", "  "]) for x in w)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("support, vocabulary", [(5, 12), (4, 25), (30, 6)])
def test_random_texts(spark, support, vocabulary):
    rng = random.Random(support)
    rows = [(i, lines(rng, rng.randrange(120), vocabulary), rng.choice(["en", "de", None, "und"])) for i in range(80)]
    wanted = brute(rows, support)
    assert got(collocations.collocations(table(spark, [(i, t, g, "s") for i, t, g in rows]), support)) == wanted and wanted


def test_hard_rows(spark):
    rng = random.Random(2)
    rows = [(i, t, "en", "s") for i, t in hard_rows()] + [(30 + i, lines(rng, 50, 5), None, "s") for i in range(9)]
    rows += [(50, "Ünder É it. ünder É IT! Ünder É it", "tr", "s"), (51, "a b a b", "tr", "s"), (52, "a. b, a; b", "tr", "s")]
    docs = table(spark, rows).withColumns({c: F.lit("own") for c in ("shard", "key", "phrase", "n", "score", "size", "rank")})
    assert got(collocations.collocations(docs, 2)) == brute(rows, 2)


def test_rare_longer_phrases_survive_the_shards(spark):
    """Phrases right at the support, spread evenly or all in one document."""
    rows = [(i, f"x{i} alpha beta gamma delta y{i}", "en") for i in range(30)] + [(99, "one two three. " * 30, "en"), (100, "four five. " * 29, "en")]
    found = got(collocations.collocations(table(spark, [(i, t, g, "s") for i, t, g in rows])))
    assert found == brute(rows) and {r[2] for r in found} == {"alpha beta gamma delta", "one two three"}


def test_many_small_flushes_and_few_shown(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FLUSH", 50)
    rng = random.Random(7)
    rows = [(i, lines(rng, 60, 9), "en") for i in range(40)]
    df = table(spark, [(i, t, g, "s") for i, t, g in rows])
    assert got(collocations.collocations(df, 4, 7)) == brute(rows, 4, 7)


def test_an_empty_table_and_texts_without_words(spark):
    assert got(collocations.collocations(table(spark, []))) == []
    assert got(collocations.collocations(table(spark, [(1, None), (2, ""), (3, " . ")]))) == []


def test_counts_beyond_64_bits(spark):
    big = 9 * 10**15
    found = spark.createDataFrame([("en", 2, "a b", big)], "lang STRING, size INT, phrase STRING, a LONG")
    counts = spark.createDataFrame(
        [("en", 1, "a", big + 1), ("en", 1, "b", big + 3), ("en", 2, "a b", big)], "lang STRING, size INT, phrase STRING, f LONG")
    n = spark.createDataFrame([("en", 3 * big)], "lang STRING, n LONG")
    assert got(collocations._ranked(found, counts, n, 5)) == [
        ("en", 1, "a b", big, big + 1, big + 3, 3 * big, 2_000_000 * big // (2 * big + 4))]


def test_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert got(queries.op11_son_collocations(spark, SMALL)) == brute(rows)


def test_tasks_are_handed_few_bytes_at_a_time(spark, monkeypatch):
    """Texts of 24 MB in all come in batches of about ``BATCH`` bytes, and the session's own setting is back afterwards."""
    docs = spark.range(0, 240, 1, 1).select("id", F.lit("en").alias("lang"), F.repeat(F.concat(F.lit("word "), F.col("id"), F.lit(" ")), 12_000).alias("text"))
    docs = docs.withColumnRenamed("id", "doc_id")
    given, most = type(docs).mapInArrow, collocations.BATCH + (1 << 20)

    def watched(self, run, schema, *rest):
        def checked(batches):
            for batch in batches:
                if batch.nbytes > most:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return given(self, lambda batches: run(checked(batches)), schema, *rest)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    before = spark.conf.get(collocations.BATCH_BYTES)
    top = collocations.collocations(docs).orderBy("rank").first()
    assert spark.conf.get(collocations.BATCH_BYTES) == before
    # The best cut is after the first "word", which stands 240 * 12,000 times.
    assert (top.phrase.split()[::2], top.a, top.l, top.r, top.n) == (["word", "word"], 11_999, 240 * 12_000, 11_999, 240 * 24_000)
