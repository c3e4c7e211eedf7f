"""Scores against labels: metrics, thresholds, gates, comparison reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import numeric as N
from twinspan.functions import text as X
from twinspan.operators.store import stage

SCORE_BUCKETS = 200


def checked_scores(scored: DataFrame) -> DataFrame:
    ok = N.valid_score("score") & F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    return scored.filter(N.require(ok, "invalid evaluation labels or scores"))


def metrics_from_counts(df: DataFrame) -> DataFrame:
    """Add precision, recall, F1 and the lower confidence bound to tp, fp, fn, tn."""
    ratio = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        df.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumn("precision_wilson_lower_95", N.wilson_lower(tp, tp + fp))
        .withColumn("examples", tp + fp + fn + F.col("tn"))
    )


def confusion_metrics(scored: DataFrame, threshold: float | Column, *by: str) -> DataFrame:
    """Confusion counts and metrics; a score at the threshold is predicted positive.

    Without ``by`` an empty input is an error.
    """
    hit = F.col("score") >= threshold
    pos = F.col("label") == 1
    counts = checked_scores(scored).groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    out = metrics_from_counts(counts)
    return out if by else out.filter(N.require(F.col("examples") > 0, "no evaluation examples"))


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score; ties are one operating point.

    Rows are first summed per score. Running totals then take two levels: a fixed
    number of score buckets, whose totals fit anywhere, and within each bucket its own
    scores. Bucket bounds are quantiles of the distinct scores, so a classifier that piles
    its scores up at 0 and 1 fills them as evenly as any other. No window spans the table.
    """
    per_score = stage(checked_scores(scored).groupBy("score").agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos")), "scores")
    shares = [i / SCORE_BUCKETS for i in range(1, SCORE_BUCKETS)]
    bounds = per_score.agg(F.percentile_approx("score", shares, 10 * SCORE_BUCKETS)).scalar()
    per_score = per_score.withColumn("bounds", bounds).withColumn(
        "bucket", F.size(F.filter("bounds", lambda b: b <= F.col("score")))).drop("bounds")
    buckets = per_score.groupBy("bucket").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp"))
    over = Window.partitionBy(F.lit(1)).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    buckets = buckets.select(
        "bucket",
        F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("bp").over(over), F.lit(0)).alias("pos_above"),
        F.sum("bp").over(whole).alias("positives"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    # At most SCORE_BUCKETS rows are broadcast.
    return (
        per_score.join(F.broadcast(buckets), "bucket")
        .withColumn("predicted", F.sum("n").over(inside) + F.col("n_above"))
        .withColumn("tp", F.sum("pos").over(inside) + F.col("pos_above"))
        .select(
            "score", "predicted", "tp",
            (F.col("tp") / F.col("predicted")).alias("precision"),
            (F.col("tp") / F.greatest(F.col("positives"), F.lit(1))).alias("recall"),
        )
    )


def select_threshold(scored: DataFrame, target_precision: float, min_recall: float) -> DataFrame:
    """One row: the best operating point meeting both targets, or null."""
    fit = (F.col("score") > 0) & (F.col("precision") >= target_precision) & (F.col("recall") >= min_recall)
    best = F.max(F.when(fit, F.struct("recall", "precision", "score"))).alias("b")
    return threshold_sweep(scored).agg(best).select(
        F.col("b.score").alias("threshold"), F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


def at_selected_threshold(scored: DataFrame, target_precision: float, min_recall: float) -> DataFrame:
    """Metrics at the selected threshold; with none selected nothing is predicted positive."""
    chosen = select_threshold(scored, target_precision, min_recall).select("threshold")
    marked = scored.withColumn("threshold", chosen.scalar())
    used = F.coalesce(F.col("threshold"), F.lit(C.NO_THRESHOLD))
    return confusion_metrics(marked, used, "threshold")


def best_epoch(history: DataFrame, *by: str) -> DataFrame:
    """The epoch with the best validation rank; the earliest wins ties.

    ``history`` has epoch, threshold, recall, precision, fallback_f1.
    """
    rank = F.struct(
        F.col("threshold").isNotNull().alias("has"), F.col("recall").alias("r"), F.col("precision").alias("p"),
        F.col("fallback_f1").alias("f"), (-F.col("epoch")).alias("e"))
    rest = F.struct("epoch", "threshold", "recall", "precision", "fallback_f1")
    return history.groupBy(*by).agg(F.max_by(rest, rank).alias("b")).select(*by, "b.*")


def gate_reasons(target_precision: float, min_recall: float, name: str | Column = "name") -> Column:
    n = X.col(name)
    enough = C.GATE_MIN_PER_CLASS
    few = ((F.col("tp") + F.col("fn")) < enough) | ((F.col("tn") + F.col("fp")) < enough)
    say = lambda c, m: F.when(c, F.concat(n, F.lit(m)))
    return F.array_compact(F.array(
        say(few, f": fewer than {enough} examples of each class"),
        say(F.col("precision_wilson_lower_95") < target_precision, ": precision confidence bound below target"),
        say(F.col("recall") < min_recall, ": recall below target"),
    ))


def serving_gate(results: DataFrame, target_precision: float, min_recall: float) -> DataFrame:
    """Metrics of named evaluations with the reasons why each fails the gate."""
    reasons = gate_reasons(target_precision, min_recall)
    if "threshold" in results.columns:
        none = F.when(F.col("threshold").isNull(), F.array(F.lit("No validation operating point met precision/recall targets")))
        reasons = F.concat(reasons, F.coalesce(none, F.array().cast("array<string>")))
    return results.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def eligible_models(meta: DataFrame, fmt: str = C.HEAD_FORMAT, encoder: str = C.HEAD_ENCODER) -> DataFrame:
    pairs = F.col("validated_language_pairs")
    allowed = F.array(*[F.lit(p) for p in C.SUPPORTED_LANGUAGE_PAIRS])
    return meta.filter(
        (F.col("format") == fmt) & (F.col("encoder") == encoder) & F.col("eligible_for_serving")
        & (F.col("threshold") > 0) & (F.col("threshold") <= 1)
        & (F.size(pairs) > 0) & (F.size(F.array_except(pairs, allowed)) == 0))


def rule_classify(sem, tok, param, lines_a, lines_b, cross, threshold) -> Column:
    """The alternative taxonomy as one expression; null below the threshold.

    A threshold of 0 means the default.
    """
    s, t, p, x = X.col(sem), X.col(tok), X.col(param), X.col(cross)
    k = C.TAXONOMY
    limit = F.coalesce(F.nullif(X.col(threshold).cast("double"), F.lit(0.0)), F.lit(C.DEFAULT_THRESHOLD))
    type2 = (X.col(lines_a) == X.col(lines_b)) & ((t >= k["type2_tokens"]) | (p >= k["type2_renamed"])) & (s >= k["type2_semantic"])
    type3 = ((t >= k["type3_tokens"]) | (p >= k["type3_renamed"])) & (s >= k["type3_semantic"])
    return (
        F.when(s < limit, F.lit(None).cast("string"))
        .when(x, "Type-4").when(t >= k["type1_tokens"], "Type-1")
        .when(type2, "Type-2").when(type3, "Type-3").otherwise("Type-4")
    )


def type_or_null(same_language, same_tokens, same_params, near_score, threshold) -> Column:
    """Most specific structural type of a pair, or null."""
    lang = X.col(same_language)
    floor = F.greatest(X.col(threshold), F.lit(C.NEAR_MISS_FLOOR))
    return F.when(lang, F.coalesce(
        F.when(X.col(same_tokens), F.lit("Type-1")),
        F.when(X.col(same_params), F.lit("Type-2")),
        F.when(X.col(near_score) >= floor, F.lit("Type-3")),
    ))


def compare_expected(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Full outer comparison on unordered region pairs: match, wrong type, missing, extra.

    Both sides have region_a, region_b (any orderable column) and clone_type.
    """
    key = lambda d, n: d.select(
        F.least("region_a", "region_b").alias("lo"), F.greatest("region_a", "region_b").alias("hi"),
        F.col("clone_type").alias(n)).dropDuplicates(["lo", "hi"])
    verdict = (
        F.when(F.col("expected").isNull(), "extra").when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("expected"), "match").otherwise("wrong type"))
    return key(actual, "actual").join(key(expected, "expected"), ["lo", "hi"], "full_outer").withColumn("verdict", verdict)


def exact_label_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """How many labels each rule set gets right; "no clone" is a label too."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("previous").eqNullSafe(F.col("expected"))).alias("previous_exact"),
        F.count_if(F.col("current").eqNullSafe(F.col("expected"))).alias("current_exact"))


def previous_rule(same_tokens, same_params, raw_ratio, param_ratio, cosine) -> Column:
    """The older rule set, for regression reports."""
    best = F.greatest(X.col(raw_ratio), X.col(param_ratio))
    return (
        F.when(X.col(same_tokens), "Type-1").when(X.col(same_params), "Type-2")
        .when(best >= C.NEAR_MISS_FLOOR, "Type-3").when(X.col(cosine) >= C.TYPE4_EMBEDDING_CUTOFF, "Type-4"))


def regression_report(cases: DataFrame) -> DataFrame:
    """Cases with the previous rule's type beside the expected and current ones."""
    return cases.withColumn(
        "previous", previous_rule("same_tokens", "same_params", "raw_ratio", "param_ratio", "cosine")
    ).withColumn("agrees", F.col("current").eqNullSafe(F.col("expected")))
