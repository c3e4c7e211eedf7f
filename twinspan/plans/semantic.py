"""Type-4 candidates on top of a structural run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import numeric as N
from twinspan.functions import text as X
from twinspan.functions.matching import sequence_ratio
from twinspan.operators import semantic as S
from twinspan.operators.copies import PLACE
from twinspan.operators.learning import featurise, score_pairs
from twinspan.operators.rollups import order_pairs
from twinspan.operators.segment import once
from twinspan.operators.store import stage
from twinspan.operators.vector_tree import cosine_join
from twinspan.plans.detect import Detection, detect

IDS = ["job_id", "a_id", "b_id"]
#: Signs that tell jobs apart in the tree of vectors.
SCOPE_SIGNS = 16


@dataclass
class SemanticRun:
    decided: DataFrame
    mode: str
    threshold: float

    def pairs(self) -> DataFrame:
        return S.type4_pairs(self.decided, self.mode)

    def counters(self) -> DataFrame:
        return S.analysis_counters(self.decided, "job_id")

    def analysis_info(self, classifier_threshold: float | None = None) -> DataFrame:
        """Per job: the analysis record with mode, cut-offs and counters, also as JSON."""
        cut = N.semantic_cutoffs(F.lit(self.threshold), F.lit(classifier_threshold).cast("double"), F.lit(self.mode))
        info = F.struct(
            F.lit(self.mode).alias("mode"), "semantic_pairs_checked",
            cut["semantic_threshold"].alias("semantic_threshold"),
            cut["corroborated_threshold"].alias("semantic_corroborated_threshold"),
            F.lit(C.COMPARISON_SCOPE).alias("comparison_scope"), F.lit(C.DETECTOR_REVISION).alias("detector_revision"),
            F.lit(C.SEMANTIC_POLICY).alias("semantic_policy"),
            "behavioral_rejections", "behavioral_consistent", "behavioral_inconclusive", "classifier_supported",
            F.struct(F.lit("complete").alias("stage"), F.array().cast("array<string>").alias("skipped_stages")).alias("progress"),
        )
        return self.counters().select("job_id", info.alias("analysis_info")).withColumn(
            "json", F.to_json("analysis_info", {"ignoreNullFields": "false"}))


def pending(detection: Detection, candidates: DataFrame, c_enabled: bool = False, validated: tuple[str, ...] = ()) -> DataFrame:
    """Candidate pairs (job_id, a_id, b_id) that a model may judge.

    Fragments sharing lines, languages out of scope, and pairs with a structural type
    are left out: copies by fingerprint, near-misses by their content pair.
    """
    cols = ["file", "language", "start_line", "end_line", "param_fp", "near_fp"]
    f = detection.fragments
    side = lambda s: f.select("job_id", F.col("frag_id").alias(f"{s}_id"), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    met = candidates.select(IDS).join(side("a"), ["job_id", "a_id"]).join(side("b"), ["job_id", "b_id"])
    same = F.col("language_a") == F.col("language_b")
    met = met.filter(S.semantic_eligible("language_a", "language_b", c_enabled, validated)).filter(
        ~X.overlaps("file_a", "start_line_a", "end_line_a", "file_b", "start_line_b", "end_line_b")
        & ~(same & (F.col("param_fp_a") == F.col("param_fp_b"))))
    near = detection.near.select(
        "job_id", F.least("near_fp_a", "near_fp_b").alias("lo"), F.greatest("near_fp_a", "near_fp_b").alias("hi"),
        F.col("language").alias("language_a"), F.col("language").alias("language_b"))
    met = met.withColumn("lo", F.least("near_fp_a", "near_fp_b")).withColumn("hi", F.greatest("near_fp_a", "near_fp_b"))
    keys = ["job_id", "language_a", "language_b", "lo", "hi"]
    return met.join(near, keys, "left_anti").select(*IDS, "language_a", "language_b")


def semantic_candidates(detection: Detection, vectors: DataFrame, threshold: float = C.DEFAULT_THRESHOLD, dim: int = C.FEATURE_DIM) -> DataFrame:
    """Pairs (job_id, a_id, b_id) of a job whose languages a base model may compare and whose cosine reaches its cut-off.

    One tree of vectors serves all jobs. A unit vector is followed by a direction of its job, signs
    from a hash: within a job the cosine c becomes (c + 1) / 2, and two jobs meet only if nearly
    all their signs agree, so that the tree drops their blocks together. What still meets across jobs goes
    by the job's name. Pairs below the cut-off, which decide nothing, are not listed.
    """
    cut = max(threshold, min(C.TYPE4_EMBEDDING_CUTOFF, C.TYPE4_CORROBORATED_CUTOFF))
    able = detection.fragments.filter(F.col("language").isin(*C.BASE_SEMANTIC_LANGUAGES)).select("job_id", "frag_id")
    mine = S.checked_vectors(vectors.join(able, ["job_id", "frag_id"], "left_semi"), "vector", dim)
    bits = F.xxhash64(F.col("job_id").cast("string"))
    signs = F.array(*[(F.shiftright(bits, k).bitwiseAND(1) * 2 - 1) / F.lit(SCOPE_SIGNS**0.5) for k in range(SCOPE_SIGNS)])
    keyed = stage(mine.select(
        F.concat_ws("\0", F.col("job_id").cast("string"), F.col("frag_id").cast("string")).alias("id"), "job_id", "frag_id",
        F.concat(F.transform(N.unit_vector("vector"), lambda x: x.cast("double")), signs).alias("scoped")), "scoped")
    found = cosine_join(keyed, (cut + 1) / 2 - 1e-7, vector="scoped")
    side = lambda s: keyed.select(F.col("id").alias(f"{s}_id"), F.col("job_id").alias(f"job_{s}"), F.col("frag_id").alias(f"frag_{s}"))
    met = found.join(side("a"), "a_id").join(side("b"), "b_id").filter("job_a = job_b")
    return met.select(F.col("job_a").alias("job_id"), F.col("frag_a").alias("a_id"), F.col("frag_b").alias("b_id"))


def detect_all(
    files: DataFrame, vectors: DataFrame, outcomes: DataFrame, threshold: float = C.DEFAULT_THRESHOLD,
    dim: int = C.FEATURE_DIM, semantic_threshold: float | None = None, **options,
) -> DataFrame:
    """All four types of ``files`` in one report, the Type-4 candidates found from the vectors; ``options`` as in ``detect``."""
    detection = detect(files, threshold, **options)
    cut = threshold if semantic_threshold is None else semantic_threshold
    candidates = semantic_candidates(detection, vectors, cut, dim)
    return all_types(detection, detect_semantic(detection, candidates, vectors, outcomes, cut, dim))


def detect_semantic(
    detection: Detection, candidates: DataFrame, vectors: DataFrame, outcomes: DataFrame,
    threshold: float = C.DEFAULT_THRESHOLD, dim: int = C.FEATURE_DIM,
) -> SemanticRun:
    """Judge given candidates with a base model: cosine of vectors plus evidence.

    ``vectors`` is (job_id, frag_id, vector) and ``outcomes`` is keyed by job_id and frag_id.
    """
    wanted = stage(pending(detection, candidates), "pending")
    used = wanted.select("job_id", F.explode(F.array("a_id", "b_id")).alias("frag_id")).distinct()
    units = S.checked_vectors(vectors.join(used, ["job_id", "frag_id"], "left_semi"), "vector", dim).select(
        "job_id", "frag_id", N.unit_vector("vector").alias("u"))
    side = lambda s: units.select("job_id", F.col("frag_id").alias(f"{s}_id"), F.col("u").alias(f"u_{s}"))
    scored = once(
        wanted.join(side("a"), ["job_id", "a_id"]).join(side("b"), ["job_id", "b_id"]), "score", N.cosine_of_units("u_a", "u_b")
    ).drop("u_a", "u_b")
    return judge(scored, outcomes, threshold, "embedding")


def detect_with_classifier(
    detection: Detection, candidates: DataFrame, vectors: DataFrame, outcomes: DataFrame, model,
    classifier_threshold: float | None, validated: tuple[str, ...] = (), threshold: float = C.DEFAULT_THRESHOLD,
    dim: int = C.FEATURE_DIM, c_enabled: bool = False,
) -> SemanticRun:
    """Judge given candidates with a fitted pair classifier plus evidence.

    ``model`` and ``classifier_threshold`` come from ``fit_pair_classifier``; a score counts without
    evidence only for the language pairs that its gate has ``validated``.
    """
    wanted = stage(pending(detection, candidates, c_enabled, validated), "pending")
    # One name per fragment over all jobs, as the features' key.
    named = lambda c: F.concat_ws("\0", F.col("job_id").cast("string"), F.col(c).cast("string"))
    used = wanted.select("job_id", F.explode(F.array("a_id", "b_id")).alias("frag_id")).distinct()
    emb = vectors.join(used, ["job_id", "frag_id"], "left_semi").select(named("frag_id").alias("id"), "vector")
    pairs = wanted.withColumnsRenamed({"a_id": "a_frag", "b_id": "b_frag"}).withColumns({"a_id": named("a_frag"), "b_id": named("b_frag")})
    scored = score_pairs(model, featurise(pairs, emb, dim)).drop("a_id", "b_id").withColumnsRenamed({"a_frag": "a_id", "b_frag": "b_id"})
    return judge(scored, outcomes, threshold, "classifier", classifier_threshold, validated)


def all_types(detection: Detection, run: SemanticRun) -> DataFrame:
    """One report: the links of Types 1 to 3 and the Type-4 pairs, in the same columns and display order."""
    side = lambda s: detection.fragments.select(
        "job_id", F.col("frag_id").alias(f"{s}_id"), *[F.col(c).alias(f"{c}_{s}") for c in ("file", *PLACE, "tokens")])
    four = run.pairs().join(side("a"), ["job_id", "a_id"]).join(side("b"), ["job_id", "b_id"])
    spot = lambda s: F.struct(*[F.col(f"{c}_{s}") for c in PLACE])
    swap = spot("a") > spot("b")
    four = four.withColumnsRenamed({"a_id": "frag_id_a", "b_id": "frag_id_b"})
    either = [F.when(swap, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}")
              for s, o in ("ab", "ba") for c in ("frag_id", "file", *PLACE, "tokens")]
    cross = F.col("language_a") != F.col("language_b")
    four = four.select(
        "job_id", F.when(cross, X.language_pair("language_a", "language_b")).otherwise(F.col("language_a")).alias("language"),
        "clone_type", "similarity", F.lit(1).cast("decimal(38,0)").alias("n_pairs"), *either, cross.alias("cross_language"), "description")
    four = four.withColumn("token_sim", N.round6(sequence_ratio("tokens_a", "tokens_b"))).drop("tokens_a", "tokens_b")
    links = detection.links()
    return order_pairs(links.unionByName(four.select(links.columns)))


def judge(
    scored: DataFrame, outcomes: DataFrame, threshold: float, mode: str, classifier_threshold: float | None = None,
    validated: tuple[str, ...] = (),
) -> SemanticRun:
    """Attach evidence to scored pending pairs and decide."""
    key = lambda c: F.concat_ws("\0", F.col("job_id").cast("string"), F.col(c).cast("string"))
    keyed = scored.withColumnsRenamed({"a_id": "a_frag", "b_id": "b_frag"})
    keyed = keyed.withColumn("a_id", key("a_frag")).withColumn("b_id", key("b_frag"))
    seen = S.evidence_join(keyed, outcomes.withColumn("frag_id", key("frag_id")).drop("job_id"))
    plain = seen.drop("a_id", "b_id").withColumnsRenamed({"a_frag": "a_id", "b_frag": "b_id"})
    decided = S.semantic_decide(plain, threshold, mode, classifier_threshold, validated)
    return SemanticRun(stage(decided, "decided"), mode, threshold)
