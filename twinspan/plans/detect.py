"""Clone detection over a table of source files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import text as X
from twinspan.functions.matching import sequence_ratio
from twinspan.functions.numeric import round6
from twinspan.operators import copies as K
from twinspan.operators import near_miss as M
from twinspan.operators import segment as G
from twinspan.operators.store import stage

PAIR_COLUMNS = [
    "job_id", "language", "clone_type", "similarity", "n_pairs",
    *[f"{c}_{s}" for s in "ab" for c in ("frag_id", "file", "file_ord", "start_line", "end_line")],
]


@dataclass
class Detection:
    """The result of a run, kept in factored form.

    ``fragments`` holds every usable fragment with its fingerprints; ``near`` holds the
    near-miss pairs of distinct contents with the number of fragment pairs behind each.
    """

    fragments: DataFrame
    near: DataFrame
    all_fragments: DataFrame

    def links(self) -> DataFrame:
        """Pairs in report shape: one row per copy and one per near-miss content pair.

        ``n_pairs`` is the number of fragment pairs a Type-3 row stands for. A copy that
        shares lines with its anchor keeps its row, so that its class is known, with
        ``n_pairs`` 0, since the two are not a pair.
        """
        copies = K.copy_links(self.fragments).withColumn(
            "n_pairs", F.when(F.col("overlapping"), 0).otherwise(1).cast("decimal(38,0)"))
        near = self.near.select(
            "job_id", "language", F.lit("Type-3").alias("clone_type"), "similarity", "n_pairs",
            *[F.col(f"rep_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("frag_id", "file", "file_ord", "start_line", "end_line")])
        return report(copies.select(PAIR_COLUMNS).unionByName(near.select(PAIR_COLUMNS)), self.fragments)

    def pairs(self, max_class: int | None = None) -> DataFrame:
        """Every pair of Types 1 to 3 in report shape; ``max_class`` fails the job on a larger class."""
        one = F.lit(1).cast("decimal(38,0)")
        copies = K.expand_pairs(self.fragments, max_class).withColumn("n_pairs", one)
        near = M.expand_near(self.near, self.fragments, max_class).withColumn("n_pairs", one)
        return report(copies.select(PAIR_COLUMNS).unionByName(near.select(PAIR_COLUMNS)), self.fragments)

    def totals(self) -> DataFrame:
        """Per job: fragments, candidate pairs and exact pair counts per type."""
        near = self.near.groupBy("job_id").agg(F.sum("n_pairs").alias("type3_pairs"))
        return (
            G.fragment_totals(self.all_fragments)
            .join(K.candidate_pair_count(self.fragments), "job_id", "left")
            .join(K.copy_pair_totals(self.fragments), "job_id", "left")
            .join(near, "job_id", "left")
            .fillna(0)
        )


def report(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """Attach token similarity and the description.

    Only the token lists of paired fragments move; Type-1 needs none.
    """
    typed1 = pairs.filter("clone_type = 'Type-1'").withColumn("token_sim", F.lit(1.0))
    rest = pairs.filter("clone_type <> 'Type-1'")
    ends = rest.select("job_id", F.explode(F.array("frag_id_a", "frag_id_b")).alias("frag_id")).distinct()
    frags = frags.select("job_id", "frag_id", "tokens").join(ends, ["job_id", "frag_id"], "left_semi")
    side = lambda s: frags.select("job_id", F.col("frag_id").alias(f"frag_id_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    scored = rest.join(side("a"), ["job_id", "frag_id_a"]).join(side("b"), ["job_id", "frag_id_b"])
    scored = scored.withColumn("token_sim", round6(sequence_ratio("tokens_a", "tokens_b"))).drop("tokens_a", "tokens_b")
    # Staged jobs hand Python little at a time.
    out = typed1.unionByName(stage(scored.select(typed1.columns), "token-similarity"))
    cross = F.lit(False)
    return out.withColumn("similarity", round6("similarity")).withColumn("cross_language", cross).withColumn(
        "description", X.clone_description("clone_type", cross))


def prepare(files: DataFrame, spans: DataFrame | None = None, python_lexer: bool = True) -> DataFrame:
    """Fragments with tokens, before the usability filter."""
    return G.with_tokens(G.fragments(files, spans), python_lexer)


def detect(
    files: DataFrame, threshold: float = C.DEFAULT_THRESHOLD, spans: DataFrame | None = None,
    python_lexer: bool = True, max_fragments: int | None = None,
) -> Detection:
    """Find clones of Types 1 to 3 within each job of ``files``.

    Fragments are tokenised once and staged; everything after reads only the columns
    it needs. Type-4 pairs come from ``semantic`` for pairs left untyped here.
    """
    tokenised = stage(prepare(files, spans, python_lexer), "tokenised")
    frags = stage(K.fingerprints(G.fragment_guard(G.usable_fragments(tokenised), max_fragments)).drop("params"), "fragments")
    return Detection(frags, stage(M.near_miss_join(frags, threshold), "near"), tokenised.drop("code"))
