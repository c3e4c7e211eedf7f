"""Datasets, thresholds and gates."""

import json

import pytest
from pyspark.sql import functions as F

from twinspan.operators import evaluate as E
from twinspan.operators import labels as L
from twinspan.sources import labeled as S

A = "int f(int a) { return a + 1; }"
B = "int g(int b) { return b * 2; }"


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label INT, score DOUBLE")


def test_threshold_keeps_ties_together(spark):
    df = scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.8, 0.1])
    assert E.select_threshold(df, 1.0, 0.1).first().threshold == 0.9
    assert E.select_threshold(df, 1.0, 1.0).first().threshold is None
    m = E.at_selected_threshold(df, 1.0, 1.0).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (0, 0, 2, 2)
    assert m.precision_wilson_lower_95 == 0.0


def test_scores_within_one_bucket_are_still_told_apart(spark):
    df = scored(spark, [1, 0, 1], [0.50003, 0.50002, 0.50001])
    rows = E.threshold_sweep(df).orderBy(F.desc("score")).collect()
    assert [(r.predicted, r.tp) for r in rows] == [(1, 1), (2, 1), (3, 2)]


def test_small_perfect_set_fails_the_gate(spark):
    m = E.confusion_metrics(scored(spark, [1, 0], [1.0, 0.0]), 0.5).withColumn("name", F.lit("test"))
    r = E.serving_gate(m, 0.95, 0.5).first()
    assert not r.eligible and len(r.reasons) == 2


@pytest.mark.parametrize("labels, scores", [([1], [1.5]), ([2], [0.5]), ([1], [float("nan")])])
def test_invalid_scores_raise(spark, labels, scores):
    with pytest.raises(Exception, match="invalid evaluation"):
        E.confusion_metrics(scored(spark, labels, scores), 0.5).collect()


def test_empty_input_raises(spark):
    with pytest.raises(Exception, match="no evaluation examples"):
        E.confusion_metrics(scored(spark, [1], [1.0]).filter("label = 5"), 0.5).collect()


def test_archive(spark, tmp_path):
    d = tmp_path / "dataset"
    d.mkdir()
    (d / "data.jsonl").write_text("\n".join(json.dumps({"idx": str(i), "func": A}) for i in range(4)))
    for split, text in (("train", "0 1 1\n1\t0 0\n"), ("valid", "2 3 1\n"), ("test", "2 9 0\n")):
        (d / f"{split}.txt").write_text(text)
    functions, pairs = S.read_pair_archive(spark, str(tmp_path))
    assert functions.count() == 4
    assert [r.id for r in L.unknown_ids(pairs, functions).collect()] == ["9"]
    assert [r.id for r in L.leakage(L.endpoints(pairs)).collect()] == ["2"]
    assert L.contradictory_pairs(pairs).count() == 1
    assert [(r.split, r.missing) for r in L.missing_labels(pairs).filter("size(missing) > 0").orderBy("split").collect()] == [("test", [1]), ("valid", [0])]


def test_duplicate_function_ids_fail(spark, tmp_path):
    d = tmp_path / "dataset"
    d.mkdir()
    (d / "data.jsonl").write_text("\n".join(json.dumps({"idx": "1", "func": A}) for _ in range(2)))
    with pytest.raises(Exception, match="duplicate function id"):
        S.read_functions(spark, str(tmp_path)).collect()


def test_labeled_reader_reports_every_reason(spark, tmp_path):
    row = lambda **k: json.dumps({"split": "train", "label": 1, "code_a": A, "code_b": B, **k})
    lines = [row(), "", "{broken", row(label=7), row(split="dev"), row(code_a=" "), row(code_a="x"), row(code_b=A + " // same", label=0)]
    path = tmp_path / "pairs.jsonl"
    path.write_text("\n".join(lines))
    rows = S.read_labeled_pairs(spark, str(path))
    good, bad = L.validate_labeled(rows)
    assert good.count() == 1
    reasons = sorted(x for r in bad.collect() for x in r.reasons)
    assert reasons == sorted([
        "invalid record", "invalid split or label", "invalid split or label", "empty code",
        "fewer than three tokens", "fewer than three tokens", "identical snippets labelled 0"])
    with pytest.raises(Exception, match="invalid labelled pair"):
        L.validate_labeled(rows, strict=True)[0].collect()


def test_expected_pairs(spark, tmp_path):
    doc = {"scope": "x", "expected_pairs": [
        {"type": "Type-1", "a": {"name": "f", "lines": [1, 4]}, "b": {"name": "g", "lines": [6, 9]}}]}
    path = tmp_path / "e.json"
    path.write_text(json.dumps(doc, indent=1))
    r = S.read_expected_pairs(spark, str(path)).first()
    assert (r.clone_type, r.name_a, r.start_line_b, r.end_line_b) == ("Type-1", "f", 6, 9)


def test_model_metadata_filter(spark):
    from twinspan import constants as C

    base = (C.HEAD_FORMAT, C.HEAD_ENCODER, True, 0.5, ["c:c"])
    rows = [base, ("x", *base[1:]), (*base[:2], False, *base[3:]), (*base[:3], 0.0, base[4]), (*base[:4], []), (*base[:4], ["go:go"])]
    df = spark.createDataFrame(rows, "format STRING, encoder STRING, eligible_for_serving BOOLEAN, threshold DOUBLE, validated_language_pairs ARRAY<STRING>")
    assert E.eligible_models(df).count() == 1
