"""From an archive of labelled pairs to a gated classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan.functions import text as X
from twinspan.functions.numeric import require
from twinspan.operators import labels as L
from twinspan.operators import segment as G
from twinspan.operators.learning import Trained, fit_pair_classifier
from twinspan.operators.store import stage
from twinspan.sources.sinks import write_run


@dataclass
class Prepared:
    audit: DataFrame
    selected: DataFrame
    duplicates: DataFrame
    exclusions: DataFrame
    pairs: DataFrame


def audit_archive(functions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per-split audit; unknown ids, missing labels or ids in two splits fail the job."""
    unknown = F.coalesce(L.unknown_ids(pairs, functions).agg(F.count("*")).scalar(), F.lit(0))
    leaked = F.coalesce(L.leakage(L.endpoints(pairs)).agg(F.count("*")).scalar(), F.lit(0))
    return (
        L.split_audit(pairs)
        .filter(require(unknown == 0, "a pair names an unknown function"))
        .filter(require(leaked == 0, "function id leakage between splits"))
        .filter(require(F.col("both_labels"), "a split lacks one of the labels"))
    )


def prepare_archive(
    functions: DataFrame, pairs: DataFrame, limits: dict[str, int], seed: int, language: str = "java",
    max_tokens: int | None = None, max_chars: int | None = None,
) -> Prepared:
    """Audit, sample without looking at labels, drop cross-split duplicates, and keep the
    pairs among what is left.

    ``max_tokens`` and ``max_chars`` are the limits of the encoder to be used, if it has any;
    code beyond them is listed as excluded. Contradictory labels among the kept pairs, and a
    split that has lost a label or all its pairs, fail the job.
    """
    audit = stage(audit_archive(functions, pairs), "audit")
    sample = L.sample_functions(L.endpoints(pairs), limits, seed)
    code = sample.join(functions, "id").withColumn("language", F.lit(language))
    code = stage(G.with_tokens(code).withColumn("fp", X.fingerprint("tokens")), "sampled")
    owned = L.first_owner(code)
    usable, excluded = G.split_encodable(owned.filter("kept"), max_tokens, max_chars)
    rows = stage(L.induced_rows(pairs, usable.select("split", "id"), usable.select("id")), "induced")
    bad = F.coalesce(L.contradictory_pairs(rows).agg(F.count("*")).scalar(), F.lit(0))
    complete = L.missing_labels(rows).agg(F.count_if(F.size("missing") == 0)).scalar()
    splits = audit.agg(F.count("*")).scalar()
    # The checks stand on the audit's rows too: there may be no pair left to carry them.
    sound = require(bad == 0, "contradictory labels for the same unordered pair") & require(
        F.coalesce(complete, F.lit(0)) == splits, "a split has lost a label or all its pairs")
    audit, kept = audit.filter(sound), L.dedupe_pairs(rows, "last").filter(sound)
    return Prepared(
        audit, usable.select("split", "id"),
        owned.filter("NOT kept").select("split", "id", F.lit("duplicate token sequence across splits").alias("reason")),
        excluded.select("split", "id", "reason"), kept,
    )


def train(
    prepared: Prepared, vectors: DataFrame, dim: int, target_precision: float, min_recall: float, folder: str | None = None,
) -> Trained:
    """Fit on the prepared pairs; with ``folder`` the whole run is written, never over another."""
    out = fit_pair_classifier(prepared.pairs, vectors, dim, target_precision, min_recall)
    if folder is not None:
        write_run({
            "audit": prepared.audit, "selected": prepared.selected, "duplicates": prepared.duplicates,
            "exclusions": prepared.exclusions, "pairs": prepared.pairs, "history": out.history,
            "report": out.gate, "test_predictions": out.test,
        }, folder)
    return out
