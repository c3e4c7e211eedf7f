"""Semantic candidates (Type-4): cosine joins, behavioural evidence, decisions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinspan import constants as C
from twinspan.functions import numeric as N
from twinspan.functions import text as X
from twinspan.functions.renaming import TOKENS, row_slices
from twinspan.operators.segment import once


def semantic_eligible(lang_a: str, lang_b: str, c_enabled: bool = False, validated: tuple[str, ...] = ()) -> Column:
    """May a model compare these languages? Any mix of the base languages; C with C
    only when switched on and validated."""
    base = F.col(lang_a).isin(*C.BASE_SEMANTIC_LANGUAGES) & F.col(lang_b).isin(*C.BASE_SEMANTIC_LANGUAGES)
    if c_enabled and "c:c" in validated:
        return base | ((F.col(lang_a) == "c") & (F.col(lang_b) == "c"))
    return base


def untyped_pairs(pairs: DataFrame, typed: DataFrame, keys: tuple[str, ...] = ("a_id", "b_id")) -> DataFrame:
    """Pairs that no structural rule has typed."""
    return pairs.join(typed.select(*keys), list(keys), "left_anti")


def pair_vectors(pairs: DataFrame, emb: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """Attach both vectors by two equi-joins; the planner broadcasts only if small."""
    side = lambda s: emb.select(F.col(key).alias(f"{s}_id"), F.col(vector).alias(f"vec_{s}"))
    return pairs.join(side("a"), "a_id").join(side("b"), "b_id")


def checked_vectors(emb: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fail on vectors of wrong length, with non-finite values or without direction."""
    return emb.filter(N.require(N.valid_vector(vector, dim), "the semantic model returned invalid embeddings"))


def cosine_pairs(pairs: DataFrame, emb: DataFrame, t: float, key: str = "id", vector: str = "vector") -> DataFrame:
    """Given pairs whose cosine reaches ``t``. Vectors are normalised once, not per pair."""
    units = emb.select(F.col(key).alias("id"), N.unit_vector(vector).alias("vector"))
    scored = once(pair_vectors(pairs, units), "cosine", N.cosine_of_units("vec_a", "vec_b"))
    return scored.drop("vec_a", "vec_b").filter(F.col("cosine") >= t)


# --- behavioural evidence ------------------------------------------------------


def probe_tables(outcomes: DataFrame) -> DataFrame:
    """One row per fragment: arity and its outcomes by sample.

    ``outcomes`` is (frag_id, arity, sample_idx, out_type, out_repr, args_repr). The
    number of samples of a fragment is fixed by the probe, so the list is small.
    """
    return outcomes.groupBy("frag_id").agg(
        F.first("arity").alias("arity"),
        F.sort_array(F.collect_list(F.struct("sample_idx", "out_type", "out_repr", "args_repr"))).alias("o"),
    )


def evidence(arity_a, a, arity_b, b) -> Column:
    """struct(status, checked, diverse_outputs) from two sorted outcome lists."""
    A, B = X.col(a), X.col(b)
    common = lambda x, other: F.filter(
        x, lambda o: F.array_contains(F.transform(other, lambda p: p["sample_idx"]), o["sample_idx"]))

    def judge(v: Column) -> Column:
        left, right = v["left"], v["right"]
        n = F.size(left)
        differs = F.zip_with(left, right, lambda x, y: x != y)
        first = F.array_position(differs, F.lit(True)).cast("int")
        disjoint = (n == 0) & (F.size(A) >= C.MIN_SHARED_SAMPLES) & (F.size(B) >= C.MIN_SHARED_SAMPLES)
        diverse = F.size(F.array_distinct(F.transform(left, lambda x: x["out_repr"])))
        unknown = A.isNull() | B.isNull() | (X.col(arity_a) != X.col(arity_b))
        result = lambda s, c, d: F.struct(
            F.lit(s).alias("status"), c.cast("int").alias("checked"), d.cast("int").alias("diverse_outputs"))
        zero = F.lit(0)
        return (
            F.when(unknown, result("inconclusive", zero, zero))
            .when(first > 0, result("different", first, zero))
            .when(disjoint, result("different", zero, zero))
            .when(n >= C.MIN_SHARED_SAMPLES, result("consistent", n, diverse))
            .otherwise(result("inconclusive", n, diverse))
        )

    return X.let(F.struct(common(A, B).alias("left"), common(B, A).alias("right")), judge)


def evidence_join(pairs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Evidence per pair (a_id, b_id); a fragment without outcomes is inconclusive.

    Outcomes are gathered once per fragment, so a pair costs two equi-joins and the
    comparison stays within its row.
    """
    tables = probe_tables(outcomes)
    side = lambda s: tables.select(
        F.col("frag_id").alias(f"{s}_id"), F.col("arity").alias(f"arity_{s}"), F.col("o").alias(f"o_{s}"))
    met = pairs.join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")
    return once(met, "e", evidence("arity_a", "o_a", "arity_b", "o_b")).drop("arity_a", "o_a", "arity_b", "o_b").select(
        "*", "e.*").drop("e")


def evidence_agg(joined: DataFrame, *by: str) -> DataFrame:
    """The same comparison as an aggregate over (pair, sample) rows with ``same`` and ``out_repr``."""
    return joined.groupBy(*by).agg(
        F.count("*").alias("shared"),
        F.bool_or(~F.col("same")).alias("any_difference"),
        F.countDistinct("out_repr").alias("diverse_outputs"),
        F.min(F.when(~F.col("same"), F.col("sample_idx"))).alias("first_difference"),
    )


def semantic_decide(
    scored: DataFrame, threshold: float, mode: str, classifier_threshold: float | None = None,
    validated: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``decision``: accepted, rejected, inconclusive or below.

    ``scored`` has score, language_a/b, status, checked, diverse_outputs, and holds
    only pairs without a structural type. A counterexample overrides any score; a base
    model alone never suffices.
    """
    low, high = (-1.0, 1.0) if mode == "embedding" else (0.0, 1.0)
    scored = scored.filter(N.require(N.valid_score("score", low, high), "the semantic classifier returned invalid scores"))
    cut = N.semantic_cutoffs(F.lit(threshold), F.lit(classifier_threshold).cast("double"), F.lit(mode))["effective"]
    corroborated = (
        (F.col("status") == "consistent")
        & (F.col("checked") >= C.MIN_AGREEING_SAMPLES)
        & (F.col("diverse_outputs") >= C.MIN_DIVERSE_OUTPUTS)
    )
    supported = F.lit(False)
    if mode == "classifier" and classifier_threshold is not None and validated:
        supported = X.language_pair("language_a", "language_b").isin(*validated)
    decision = (
        F.when(F.col("score") < cut, "below")
        .when(F.col("status") == "different", "rejected")
        .when(corroborated | supported, "accepted")
        .otherwise("inconclusive")
    )
    return scored.withColumn("corroborated", corroborated).withColumn("decision", decision)


def analysis_counters(decided: DataFrame, *by: str) -> DataFrame:
    hit = lambda c: F.count_if(c)
    ok = F.col("decision") == "accepted"
    return decided.groupBy(*by).agg(
        F.count("*").alias("semantic_pairs_checked"),
        hit(F.col("decision") == "rejected").alias("behavioral_rejections"),
        hit(ok & F.col("corroborated")).alias("behavioral_consistent"),
        hit(F.col("decision") == "inconclusive").alias("behavioral_inconclusive"),
        hit(ok & ~F.col("corroborated")).alias("classifier_supported"),
    )


def type4_pairs(decided: DataFrame, mode: str) -> DataFrame:
    return decided.filter("decision = 'accepted'").withColumn("clone_type", F.lit("Type-4")).withColumn(
        "similarity", N.round6("score")).withColumn(
        "description", X.type4_description(F.lit(mode), "corroborated", "checked"))


# --- hashed features -----------------------------------------------------------


def hash_features(df: DataFrame, key: str, text: str, dim: int = C.FEATURE_DIM) -> DataFrame:
    """Sparse, L2-normalised signed feature counts of token classes and their bigrams.

    Structural features only: they carry no meaning, so they may never support a
    Type-4 pair. Counts of some rows of a batch are summed at once; each distinct feature
    of theirs is digested once.
    """
    classes = once(df.select(F.col(key).alias("id"), F.col(text).alias("t")), "c", X.structural_class(X.word_tokens_lower("t")))
    marks = classes.select("id", F.concat("c", X.bigrams("c")).alias("f")).filter("f IS NOT NULL")

    def place(feature: str) -> tuple[int, int]:
        digest = hashlib.md5(feature.encode()).hexdigest()
        return int(digest[:8], 16) % dim, 1 if int(digest[9], 16) % 2 else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, high - low) for b in batches for low, high in row_slices(b.column("f"), TOKENS)):
            lists = batch.column("f")
            named = lists.flatten().dictionary_encode()
            places = np.array([place(f) for f in named.dictionary.to_pylist()], np.int64).reshape(-1, 2)
            index, sign = places[named.indices.to_numpy()].T
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            cells, which = np.unique(row * dim + index, return_inverse=True)
            sums = np.bincount(which, sign, len(cells)).astype(np.int64)
            cells, sums = cells[sums != 0], sums[sums != 0]
            row = cells // dim
            norm = np.sqrt(np.bincount(row, sums * sums, batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(cells % dim), pa.array(sums / norm[row])], ["id", "index", "value"])

    kind = T.StructType([T.StructField("id", marks.schema["id"].dataType), T.StructField("index", T.LongType()), T.StructField("value", T.DoubleType())])
    return marks.mapInArrow(run, kind).withColumnRenamed("id", key)
