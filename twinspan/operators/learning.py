"""Training and applying a pair classifier with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.functions import numeric as N
from twinspan.operators import evaluate as E
from twinspan.operators.semantic import checked_vectors, pair_vectors
from twinspan.operators.store import stage


def featurise(pairs: DataFrame, emb: DataFrame, dim: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """Symmetric pair features as an ML vector column."""
    met = pair_vectors(pairs, checked_vectors(emb, vector, dim), key, vector)
    return met.withColumn("features", array_to_vector(N.pair_features("vec_a", "vec_b"))).drop("vec_a", "vec_b")


def score_pairs(model, features: DataFrame) -> DataFrame:
    """Clone probability per pair; scores outside [0, 1] fail the job."""
    scored = model.transform(features).withColumn("score", vector_to_array("probability")[1])
    return scored.filter(N.require(N.valid_score("score"), "the classifier returned invalid scores")).drop(
        "features", "rawPrediction", "probability", "prediction")


@dataclass
class Trained:
    model: object
    history: DataFrame
    validation: DataFrame
    test: DataFrame
    gate: DataFrame


def candidates(dim: int, seed: int):
    """The settings that compete on the validation split."""
    shared = dict(featuresCol="features", labelCol="label")
    return [
        LogisticRegression(regParam=0.01, maxIter=30, **shared),
        LogisticRegression(regParam=0.3, maxIter=30, **shared),
        MultilayerPerceptronClassifier(layers=[2 * dim, dim, 2], maxIter=40, seed=seed, **shared),
    ]


def fit_pair_classifier(
    pairs: DataFrame, emb: DataFrame, dim: int, target_precision: float = 0.95, min_recall: float = 0.5, seed: int = 42,
) -> Trained:
    """Fit on train, choose model and threshold on valid only, score test once.

    ``pairs`` has split, a_id, b_id and label. Features are staged, so each fit reads
    them instead of repeating the joins.
    """
    spark = pairs.sparkSession
    data = stage(featurise(pairs, emb, dim), "features")
    part = lambda s: data.filter(F.col("split") == s)
    rows, models = [], []
    for number, setting in enumerate(candidates(dim, seed), 1):
        model = setting.fit(part("train"))
        scored = stage(score_pairs(model, part("valid")).select("label", "score"), "valid-scores")
        # One row of summary figures per setting.
        best = E.at_selected_threshold(scored, target_precision, min_recall).first()
        plain = E.confusion_metrics(scored, 0.5).first()
        rows.append((number, best["threshold"], best["recall"], best["precision"], plain["f1"]))
        models.append((model, scored))
    history = spark.createDataFrame(rows, "epoch INT, threshold DOUBLE, recall DOUBLE, precision DOUBLE, fallback_f1 DOUBLE")
    chosen = E.best_epoch(history).first()
    model, scored = models[chosen["epoch"] - 1]
    threshold = chosen["threshold"] if chosen["threshold"] is not None else E.C.NO_THRESHOLD
    test_scores = stage(score_pairs(model, part("test")), "test-scores")
    validation = E.confusion_metrics(scored, threshold)
    test = E.confusion_metrics(test_scores, threshold)
    named = validation.withColumn("name", F.lit("validation")).unionByName(test.withColumn("name", F.lit("test")))
    named = named.withColumn("threshold", F.lit(chosen["threshold"]).cast("double"))
    return Trained(model, history, validation, test_scores, E.serving_gate(named, target_precision, min_recall))
