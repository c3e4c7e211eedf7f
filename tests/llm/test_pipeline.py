"""The pipeline, stage by stage, against brute force on the smallest table."""

import pytest
import sentencepiece

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.common import DOCS, hard_rows, prose, table, words
from twinspan.llm import mixing
from twinspan.llm.queries import tokenizer_path

KEPT = ("doc_id", "text", "lang", "source")


def rows_of(df):
    return [tuple(r) for r in df.select(*KEPT).collect()]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        step(spark, docs, SMALL).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_all_but_the_last_keep_the_columns(spark, stages):
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert all(out.columns == given.columns and out.dtypes == given.dtypes for _, out in stages[:-1])


def test_quality_stage(stages):
    given, out = map(rows_of, stages[0])
    kept = {r[0] for r in brute.quality(given) if r[-1]}
    assert sorted(out) == sorted(r for r in given if r[0] in kept) and 0 < len(out) < len(given)


def test_near_duplicate_stage(stages):
    given, out = map(rows_of, stages[1])
    ids = {c for _, c in brute.near_classes(given)[0]}
    assert sorted(out) == sorted(r for r in given if r[0] in ids) and len(out) < len(given)


def test_passage_stage(stages):
    given, out = map(rows_of, stages[2])
    left = {r[0]: (r[2], r[3]) for r in brute.passages(given)}
    texts = {r[0]: r[1] for r in given}
    for i, text, *_ in out:
        removed, digest = left[i]
        assert text == texts[i] if not removed else brute.sha(text) == digest
    assert {r[0] for r in given} - {r[0] for r in out} == {i for i, (n, d) in left.items() if n and d == brute.sha("")}


def test_mixing_stage(stages):
    given, out = map(rows_of, stages[3])
    sizes, taken = {}, {}
    for rows, total in ((given, sizes), (out, taken)):
        for _, text, _, source in rows:
            total[source] = total.get(source, 0) + len(words(text))
    target = mixing.target_sizes(list(sizes.items()))
    largest = max(len(words(t)) for _, t, *_ in given)
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in target.items())
    assert set(out) <= set(given) and max(out.count(r) for r in set(out)) <= 2


def test_encoding_stage(stages):
    given, out = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    wanted = sorted((r["doc_id"], library.encode(r["text"])) for r in given.collect())
    assert sorted((r["doc_id"], list(r["ids"])) for r in out.collect()) == wanted


def test_run_is_the_stages(spark, stages):
    key = lambda df: sorted((r["doc_id"], tuple(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SMALL)) == key(stages[-1][1])


def test_hard_rows_and_empty_tables_pass_all_stages(spark, tmp_path):
    clash = lambda df: df.selectExpr("*", "'own' AS kept", "1 AS _in0", "'k' AS doc", "2 AS row", "3 AS copy", "4 AS _text")
    rows = [*hard_rows(), *((100 + i, prose(__import__("random").Random(i), 80), None, None) for i in range(20))]
    for n, docs in enumerate((clash(table(spark, rows)), spark.createDataFrame([], DOCS))):
        for name, step in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{n}-{name}")
            out = step(spark, docs, SMALL)
            assert name == "sentencepiece" or out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        assert (docs.count() > 0) == (n == 0)
