"""Whole pipelines on small inputs."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from twinspan.operators import segment as G
from twinspan.plans.detect import detect
from twinspan.plans.semantic import all_types, detect_semantic, detect_with_classifier, semantic_candidates
from twinspan.plans.train import prepare_archive, train

PARTS = [
    "def plus(x, y):\n    return x + y\n",
    "def plus(x, y):\n    # the same again\n    return x + y\n",
    "def join_up(first, second):\n    return first + second\n",
    "def plus_more(x, y):\n    return x + y + 1\n",
    "def product(k):\n    if k <= 1:\n        return 1\n    return k * product(k - 1)\n",
    "def multiply_down(k):\n    out = 1\n    while k > 1:\n        out *= k\n        k -= 1\n    return out\n",
]


@pytest.mark.parametrize("layout", ["single", "flat", "nested"])
def test_every_layout_finds_one_two_three(sources, layout):
    if layout == "single":
        files = sources(("all.py", "\n\n".join(PARTS)))
    else:
        folder = "" if layout == "flat" else "deep/er/"
        files = sources(*[(f"{folder}{i}.py", p) for i, p in enumerate(PARTS)])
    found = detect(files, 0.8, G.indent_blocks(G.split_lines(files)))
    rows = found.pairs().groupBy("clone_type").count().collect()
    assert {r["clone_type"]: r["count"] for r in rows} == {"Type-1": 1, "Type-2": 2, "Type-3": 3}
    t = found.totals().first()
    assert (t.type1_pairs, t.type2_pairs, t.type3_pairs) == (1, 2, 3)


def test_mixed_languages_with_vectors(spark, sources):
    files = sources(
        ("one.py", 'print("hi")'), ("copy.py", 'print("hi")'), ("two.java", 'System.out.println("hi");'),
        ("other.java", "for(int i=0; i<9; i++) { total += i; }"))
    d = detect(files)
    ids = {r.file: r.frag_id for r in d.fragments.collect()}
    order = ["one.py", "copy.py", "two.java", "other.java"]
    pairs = spark.createDataFrame(
        [("job", ids[a], ids[b]) for a, b in itertools.combinations(order, 2)], "job_id STRING, a_id STRING, b_id STRING")
    vectors = spark.createDataFrame(
        [("job", ids[f], v) for f, v in zip(order, ([1.0, 0.0], [1.0, 0.0], [0.9, 0.43589], [0.0, 1.0]))],
        "job_id STRING, frag_id STRING, vector ARRAY<DOUBLE>")
    none = spark.createDataFrame([], "job_id STRING, frag_id STRING, arity INT, sample_idx INT, out_type STRING, out_repr STRING, args_repr STRING")
    run = detect_semantic(d, pairs, vectors, none, dim=2)
    c = run.counters().first()
    assert (c.semantic_pairs_checked, c.behavioral_inconclusive) == (5, 2)
    assert run.pairs().count() == 0
    assert [r.clone_type for r in d.pairs().collect()] == ["Type-1"]
    info = json.loads(run.analysis_info().first().json)
    assert info["mode"] == "embedding" and info["semantic_threshold"] == 0.85 and info["progress"]["stage"] == "complete"
    zero = vectors.withColumn("vector", F.array(F.lit(0.0), F.lit(0.0)))
    with pytest.raises(Exception, match="invalid embeddings"):
        detect_semantic(d, pairs, zero, none, dim=2)


def test_corroborated_pair_becomes_type4(spark, sources):
    d = detect(sources(("a.py", PARTS[4]), ("b.py", PARTS[5])))
    a, b = (r.frag_id for r in d.fragments.orderBy("file").collect())
    pairs = spark.createDataFrame([("job", a, b)], "job_id STRING, a_id STRING, b_id STRING")
    vectors = spark.createDataFrame([("job", a, [1.0, 0.1]), ("job", b, [1.0, 0.0])], "job_id STRING, frag_id STRING, vector ARRAY<DOUBLE>")
    rows = [("job", f, 1, i, "int", str(v), "") for f in (a, b) for i, v in enumerate([1, 1, 2, 6, 24])]
    out = spark.createDataFrame(rows, "job_id STRING, frag_id STRING, arity INT, sample_idx INT, out_type STRING, out_repr STRING, args_repr STRING")
    r = detect_semantic(d, pairs, vectors, out, dim=2).pairs().first()
    assert r.clone_type == "Type-4" and "5 bounded Python samples agree" in r.description
    differing = out.withColumn("out_repr", F.when((F.col("frag_id") == b) & (F.col("sample_idx") == 3), "7").otherwise(F.col("out_repr")))
    assert detect_semantic(d, pairs, vectors, differing, dim=2).counters().first().behavioral_rejections == 1


def test_one_report_of_all_types(spark, sources):
    """Copies, and a loop that a recursion equals, come in one table, Type-4 first."""
    d = detect(sources(("a.py", PARTS[4]), ("b.py", PARTS[5]), ("c.py", PARTS[4])))
    ids = {r.file: r.frag_id for r in d.fragments.collect()}
    pairs = spark.createDataFrame([("job", ids["b.py"], ids["a.py"]), ("job", ids["a.py"], ids["c.py"])], "job_id STRING, a_id STRING, b_id STRING")
    vectors = spark.createDataFrame(
        [("job", ids[f], v) for f, v in (("a.py", [1.0, 0.1]), ("b.py", [1.0, 0.0]), ("c.py", [1.0, 0.1]))],
        "job_id STRING, frag_id STRING, vector ARRAY<DOUBLE>")
    rows = [("job", f, 1, i, "int", str(v), "") for f in ids.values() for i, v in enumerate([1, 1, 2, 6, 24])]
    out = spark.createDataFrame(rows, "job_id STRING, frag_id STRING, arity INT, sample_idx INT, out_type STRING, out_repr STRING, args_repr STRING")
    report = all_types(d, detect_semantic(d, pairs, vectors, out, dim=2)).collect()
    assert [(r.clone_type, r.file_a, r.file_b, r.cross_language) for r in report] == [
        ("Type-4", "a.py", "b.py", False), ("Type-1", "a.py", "c.py", False)]
    assert 0 < report[0].token_sim < 1 and report[1].token_sim == 1.0 and "samples agree" in report[0].description


def test_candidates_come_from_the_vectors_of_a_job(spark, sources):
    """Every pair of one job that reaches the cut-off, and no pair across jobs, though all jobs share one tree."""
    import math
    import random

    body = "int f{i}(int n) {{ int s{i} = {i}; while (n > {i}) {{ s{i} += n * {i}; n--; }} return s{i}; }}"
    jobs = [sources(*[(f"{i}.java", body.format(i=i)) for i in range(12)], job=f"job{j}") for j in range(5)]
    files = jobs[0]
    for more in jobs[1:]:
        files = files.unionByName(more)
    d = detect(files.unionByName(sources(("x.c", body.format(i=99)), job="job0")), 1.0)
    rng = random.Random(3)
    ids = sorted((r.job_id, r.frag_id, r.language) for r in d.fragments.collect())
    assert len(ids) == 61
    vec = {(j, f): [rng.gauss(0, 1) for _ in range(3)] for j, f, _ in ids}
    vectors = spark.createDataFrame([(j, f, v) for (j, f), v in vec.items()], "job_id STRING, frag_id STRING, vector ARRAY<DOUBLE>")
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / math.hypot(*x) / math.hypot(*y)
    for cut in (0.5, 0.9):
        got = {(r.job_id, *sorted((r.a_id, r.b_id))) for r in semantic_candidates(d, vectors, cut, 3).collect()}
        want = {(j, *sorted((f, g))) for j, f, x in ids for k, g, y in ids
                if j == k and f < g and x == y == "java" and cos(vec[j, f], vec[k, g]) >= max(cut, 0.7)}
        assert got == want and want
    assert semantic_candidates(d, vectors.limit(0), 0.5, 3).count() == 0


def test_classifier_mode(spark, sources):
    functions, labelled, code_vectors = archive(spark, 30)
    ready = prepare_archive(functions, labelled, {"train": 0, "valid": 0, "test": 0}, 1)
    fitted = train(ready, code_vectors, 3, 0.5, 0.5)
    d = detect(sources(("a.py", PARTS[4]), ("b.java", "int down(int k) { int out = 1; while (k > 1) { out *= k; k--; } return out; }")))
    a, b = (r.frag_id for r in d.fragments.orderBy("file").collect())
    pairs = spark.createDataFrame([("job", a, b)], "job_id STRING, a_id STRING, b_id STRING")
    vectors = spark.createDataFrame([("job", a, [1.0, 0.3, 0.5]), ("job", b, [1.0, 0.3, 0.5])], "job_id STRING, frag_id STRING, vector ARRAY<DOUBLE>")
    none = spark.createDataFrame([], "job_id STRING, frag_id STRING, arity INT, sample_idx INT, out_type STRING, out_repr STRING, args_repr STRING")
    for validated, found in (((), 0), (("java:python",), 1)):
        run = detect_with_classifier(d, pairs, vectors, none, fitted.model, 0.6, validated, dim=3)
        rows = [r for r in all_types(d, run).collect() if r.clone_type == "Type-4"]
        assert len(rows) == found
        assert all(r.cross_language and r.language == "java:python" for r in rows)


def archive(spark, n=60):
    """Functions of two families in three splits; a pair is positive within a family."""
    rows, pairs = [], []
    for s, split in enumerate(("train", "valid", "test")):
        for i in range(n):
            rows.append((f"{split}{i}", f"int f{s}_{i}(int a) {{ return a {'+' if i % 2 else '*'} {s * n + i}; }}"))
        for i in range(n):
            for k in (1, 2):
                j = (i + k) % n
                pairs.append((split, f"{split}{i}", f"{split}{j}", int(i % 2 == j % 2), len(pairs)))
    functions = spark.createDataFrame(rows, "id STRING, code STRING")
    labelled = spark.createDataFrame(pairs, "split STRING, a_id STRING, b_id STRING, label INT, ordinal LONG")
    family = F.when(F.col("code").contains("+"), 1.0).otherwise(-1.0)
    vectors = functions.select("id", F.array(family, F.lit(0.3), family * 0.5).alias("vector"))
    return functions, labelled, vectors


def test_training_run(spark, tmp_path):
    functions, labelled, vectors = archive(spark)
    ready = prepare_archive(functions, labelled, {"train": 0, "valid": 0, "test": 0}, 1)
    assert ready.duplicates.count() == 0 and ready.audit.count() == 3
    out = train(ready, vectors, 3, 0.5, 0.5, str(tmp_path / "run"))
    gate = {r.name: r for r in out.gate.collect()}
    assert gate["test"].precision == 1.0 and gate["test"].recall == 1.0
    assert not gate["test"].eligible and "fewer than 100" in gate["test"].reasons[0]
    assert spark.read.json(str(tmp_path / "run/test_predictions")).count() == 120
    with pytest.raises(Exception, match="(?i)exists"):
        train(ready, vectors, 3, 0.5, 0.5, str(tmp_path / "run"))


def test_leakage_fails_the_audit(spark):
    functions, labelled, _ = archive(spark, 6)
    leaked = labelled.unionByName(spark.createDataFrame([("test", "train0", "train1", 0, 999)], labelled.schema))
    with pytest.raises(Exception, match="leakage"):
        prepare_archive(functions, leaked, {"train": 0, "valid": 0, "test": 0}, 1)


def test_contradiction_fails(spark):
    functions, labelled, _ = archive(spark, 6)
    twisted = labelled.unionByName(spark.createDataFrame([("train", "train1", "train0", 1, 999)], labelled.schema))
    with pytest.raises(Exception, match="contradictory"):
        prepare_archive(functions, twisted, {"train": 0, "valid": 0, "test": 0}, 1).pairs.collect()


def test_labels_are_checked_after_induction(spark):
    """A pair of a function with itself never trains, so its labels don't matter; a split that loses a label does."""
    functions, labelled, _ = archive(spark, 6)
    selves = spark.createDataFrame([("train", "train1", "train1", v, 900 + v) for v in (0, 1)], labelled.schema)
    ready = prepare_archive(functions, labelled.unionByName(selves), {"train": 0, "valid": 0, "test": 0}, 1)
    assert ready.pairs.count() > 0
    thin = prepare_archive(functions, labelled, {"train": 2, "valid": 2, "test": 2}, 1)
    with pytest.raises(Exception, match="lost a label"):
        thin.audit.collect()


def test_encoder_limits_are_a_parameter(spark):
    functions, labelled, _ = archive(spark, 8)
    long = "int f0_0(int a) { return " + " + ".join(f"a * {i}" for i in range(700)) + "; }"
    functions = functions.withColumn("code", F.when(F.col("id") == "train0", long).otherwise(F.col("code")))
    every = {"train": 0, "valid": 0, "test": 0}
    assert prepare_archive(functions, labelled, every, 1).exclusions.count() == 0
    cut = prepare_archive(functions, labelled, every, 1, max_tokens=509)
    assert [r.id for r in cut.exclusions.collect()] == ["train0"] and "509" in cut.exclusions.first().reason
