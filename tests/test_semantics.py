"""Evidence, decisions and failing closed."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspan.operators import semantic as S
from twinspan.operators import vector_tree

OUT = "frag_id STRING, arity INT, sample_idx INT, out_type STRING, out_repr STRING, args_repr STRING"


def judge(spark, a, b, arity=(1, 1)):
    rows = [("a", arity[0], i, "int", str(v), "") for i, v in (a or {}).items()]
    rows += [("b", arity[1], i, "int", str(v), "") for i, v in (b or {}).items()]
    pairs = spark.createDataFrame([("a", "b")], "a_id STRING, b_id STRING")
    r = S.evidence_join(pairs, spark.createDataFrame(rows, OUT)).first()
    return r.status, r.checked, r.diverse_outputs


@pytest.mark.parametrize("a, b, arity, expected", [
    (None, {0: 1, 1: 2, 2: 3}, (1, 1), ("inconclusive", 0, 0)),
    ({0: 1, 1: 2, 2: 3}, {0: 1, 1: 2, 2: 3}, (1, 2), ("inconclusive", 0, 0)),
    ({0: 1, 1: 2, 2: 3}, {0: 1, 1: 2, 2: 3}, (1, 1), ("consistent", 3, 3)),
    ({0: 1, 1: 2, 5: 9}, {0: 1, 1: 3, 5: 8}, (1, 1), ("different", 2, 0)),
    ({0: 1, 1: 2, 2: 3}, {7: 1, 8: 2, 9: 3}, (1, 1), ("different", 0, 0)),
    ({0: 1, 1: 2}, {7: 1, 8: 2, 9: 3}, (1, 1), ("inconclusive", 0, 0)),
    ({i: 4 for i in range(10)}, {i: 4 for i in range(10)}, (1, 1), ("consistent", 10, 1)),
    ({0: 1, 1: 2}, {0: 1, 1: 2}, (1, 1), ("inconclusive", 2, 2)),
])
def test_evidence(spark, a, b, arity, expected):
    assert judge(spark, a, b, arity) == expected


def test_mutated_arguments_and_types_count(spark):
    rows = [("a", 1, 0, "int", "1", "[1]"), ("b", 1, 0, "int", "1", "[]")]
    pairs = spark.createDataFrame([("a", "b")], "a_id STRING, b_id STRING")
    assert S.evidence_join(pairs, spark.createDataFrame(rows, OUT)).first().status == "different"


def decide(spark, score, status, checked, diverse, mode="embedding", langs=("python", "python"), **kw):
    df = spark.createDataFrame(
        [(score, status, checked, diverse, *langs)],
        "score DOUBLE, status STRING, checked INT, diverse_outputs INT, language_a STRING, language_b STRING")
    return S.semantic_decide(df, 0.5, mode, **kw).first().decision


def test_embedding_decisions(spark):
    assert decide(spark, 0.99, "consistent", 3, 3) == "inconclusive"
    assert decide(spark, 0.99, "consistent", 10, 1) == "inconclusive"
    assert decide(spark, 0.99, "inconclusive", 0, 0) == "inconclusive"
    assert decide(spark, 0.70, "consistent", 5, 3) == "accepted"
    assert decide(spark, 0.69, "consistent", 9, 9) == "below"
    assert decide(spark, 1.0, "different", 1, 0) == "rejected"


def test_classifier_decisions(spark):
    kw = dict(mode="classifier", classifier_threshold=0.6, validated=("c:c", "java:python"))
    assert decide(spark, 0.6, "inconclusive", 0, 0, langs=("python", "java"), **kw) == "accepted"
    assert decide(spark, 0.6, "inconclusive", 0, 0, langs=("java", "java"), **kw) == "inconclusive"
    assert decide(spark, 0.59, "consistent", 9, 9, **kw) == "below"
    assert decide(spark, 0.99, "different", 1, 0, langs=("c", "c"), **kw) == "rejected"


@pytest.mark.parametrize("bad", [[0.0, 0.0, 0.0], [1.0, math.nan, 0.0], [1.0, 2.0], [math.inf, 0.0, 0.0]])
def test_bad_vectors_fail_the_job(spark, bad):
    df = spark.createDataFrame([(1, bad)], "id INT, vector ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="invalid embeddings"):
        S.checked_vectors(df, "vector", 3).collect()


def test_bad_scores_fail_the_job(spark):
    with pytest.raises(Exception, match="invalid scores"):
        decide(spark, 1.2, "consistent", 9, 9, mode="classifier", classifier_threshold=0.5)


@pytest.mark.parametrize("t", [0.2, 0.7, 0.95])
def test_cosine_join_is_complete(spark, t, monkeypatch):
    monkeypatch.setattr(vector_tree, "BLOCK", 8)
    monkeypatch.setattr(vector_tree, "PIVOTS", 8)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    v = np.vstack([c + rng.normal(scale=0.25, size=(15, 16)) for c in centres])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id INT, vector ARRAY<DOUBLE>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    expected = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if c[i, j] >= t}
    rows = vector_tree.cosine_join(df, t).collect()
    got = {(r.a_id, r.b_id) for r in rows}
    assert got == expected and len(rows) == len(got) and expected


def test_far_blocks_of_clustered_vectors_never_meet(spark, monkeypatch):
    monkeypatch.setattr(vector_tree, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    v = np.vstack([c + rng.normal(scale=0.05, size=(30, 32)) for c in centres])
    units = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)], "id INT, u ARRAY<DOUBLE>")
    tree = vector_tree.levels(units)
    n = tree[0].count()
    met = vector_tree.near_blocks(tree, float(np.arccos(0.95))).count()
    assert len(tree) > 2 and n >= len(v) / 16 and met < n * n / 10


def test_cosine_join_of_few_or_equal_vectors(spark):
    schema = "id LONG, vector ARRAY<DOUBLE>"
    assert vector_tree.cosine_join(spark.createDataFrame([], schema), 0.9).count() == 0
    assert vector_tree.cosine_join(spark.createDataFrame([(1, [1.0, 0.0])], schema), 0.9).count() == 0
    rows = vector_tree.cosine_join(spark.createDataFrame([(i, [3.0, 4.0]) for i in range(5)] + [(9, [-3.0, -4.0])], schema), 1.0 - 1e-9).collect()
    assert sorted((r.a_id, r.b_id) for r in rows) == [(i, j) for i in range(5) for j in range(i + 1, 5)]


def test_semantic_scope(spark):
    langs = [("python", "java"), ("java", "java"), ("c", "c"), ("c", "java")]
    df = spark.createDataFrame(langs, "a STRING, b STRING")
    assert df.filter(S.semantic_eligible("a", "b")).count() == 2
    assert df.filter(S.semantic_eligible("a", "b", True, ())).count() == 2
    assert df.filter(S.semantic_eligible("a", "b", True, ("c:c",))).count() == 3


def test_blocks_move_once_per_group_they_meet(spark):
    n = 100
    pairs = spark.createDataFrame([(a, b) for a in range(n) for b in range(a, n)], "a LONG, b LONG")
    met = vector_tree.meetings(pairs).cache()
    assert met.count() < n * (n + 1) / 2 / 12
    back = met.select("group", "lane", "block", F.explode("partners").alias("a"))
    assert back.select("a", F.col("block").alias("b")).exceptAll(pairs).count() == 0 and back.count() == pairs.count()
    assert max(r["count"] for r in met.groupBy("group", "lane").count().collect()) <= vector_tree.LANE
