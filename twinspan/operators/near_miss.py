"""Near-miss pairs (Type-3): a lossless weighted similarity join.

The score of a pair is twice its matched weight over the sum of both weights. Matched
runs are disjoint equal token runs, so the matched weight never exceeds the weighted
bag intersection I, and a pair at or above tau needs I >= tau/2 (Wa+Wb). From that:

  length     Wb >= tau/(2-tau) Wa, and the other way round, by weight band
  classes    no weight class can share more than the lesser of both sides has of it
  bag        I itself, for all pairs of two blocks as one matrix product
  bound      common subsequence per weight class
  verify     the exact score

Each filter only drops pairs that cannot reach tau. All but the last work on shapes
(``bag_blocks``), the distinct parameterised token lists: literals weigh the same whatever
their value, so overlap of shapes bounds overlap of contents from above. Copies, renamed
copies and copies with other literals are one shape, never compared with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import text as X
from twinspan.functions.matching import SLACK, near_miss_udf
from twinspan.functions.numeric import require
from twinspan.operators.bag_blocks import matching_pairs, scored_pairs
from twinspan.operators.copies import PLACE, overlapping_fragments, place, salted
from twinspan.operators.segment import once
from twinspan.operators.store import stage

KEY = ["job_id", "language"]
#: Contents of a shape that travel with it; those of a shape with more are fetched for its pairs.
AT_HAND = 4


def tau(threshold: float) -> float:
    return max(threshold, C.NEAR_MISS_FLOOR)


def contents(frags: DataFrame) -> DataFrame:
    """One row per distinct near-miss token list: size of its class and earliest member."""
    return frags.groupBy(*KEY, "param_fp", "near_fp").agg(
        F.count("*").alias("n_members"),
        F.min_by(F.struct("frag_id", "file", *PLACE), place()).alias("rep"),
        F.first("near").alias("near"),
    ).withColumn("codes", X.token_codes("near"))


def shapes(rows: DataFrame) -> DataFrame:
    """One row per distinct parameterised token list of a job and language.

    ``rows`` are fragments or contents; a literal in them becomes ``LITERAL`` again.
    """
    return rows.groupBy(*KEY, "param_fp").agg(F.first("near").alias("near")).select(
        *KEY, "param_fp", F.transform("near", lambda t: F.when(X.is_literal(t), "LITERAL").otherwise(t)).alias("toks"),
    ).withColumn("codes", X.token_codes("toks"))


def shape_pairs(rows: DataFrame, t: float, name: str, others: DataFrame | None = None) -> DataFrame:
    """KEY, param_fp_a, param_fp_b of shapes whose bags and common subsequences can reach ``t``.

    With ``others`` each pair has one shape of each table; it comes once, whichever holds both.
    """
    ids = lambda d: d.withColumnRenamed("param_fp", "id")
    met = matching_pairs(ids(rows), t, True, name, None if others is None else ids(others))
    pairs = met.select(*KEY, F.least("id_a", "id_b").alias("param_fp_a"), F.greatest("id_a", "id_b").alias("param_fp_b"))
    return pairs if others is None else pairs.distinct()


def spread(met: DataFrame, n: int, a: str, b: str) -> DataFrame:
    """Spread ``n`` pairs with their token lists evenly before scoring.

    Scoring a pair takes far longer than moving it, and the joins leave long lists and
    frequent partners together in few tasks. Rows of one ``b`` go to at most eight
    places, so its profile is reused and no partner is too frequent.
    """
    cores = met.sparkSession.sparkContext.defaultParallelism
    parts = min(n // 64 + 1, max(4 * cores, n // 50_000))
    return met.repartition(parts, F.col(b), F.pmod(F.xxhash64(a), F.lit(8)))


def verify(pairs: DataFrame, distinct: DataFrame, t: float) -> DataFrame:
    """Contents of the paired shapes whose exact score reaches ``t``."""
    def side(s):
        cols = ("param_fp", "codes", "near_fp", "n_members", "rep")
        return distinct.select(*KEY, *[F.col(c).alias(f"{c}_{s}") for c in cols])

    met = pairs.join(side("a"), [*KEY, "param_fp_a"]).join(side("b"), [*KEY, "param_fp_b"])
    met = spread(met, pairs.count(), "near_fp_a", "near_fp_b")
    return once(met, "similarity", near_miss_udf(t)("near_fp_a", "near_fp_b", "codes_a", "codes_b")).filter(
        "similarity IS NOT NULL").drop("codes_a", "codes_b", "param_fp_a", "param_fp_b")


def near_miss_contents(distinct: DataFrame, t: float) -> DataFrame:
    """Pairs of distinct contents with exact score at least ``t``; stage ``distinct`` first.

    Pairs are scored where the blocks of shapes meet, so that no list moves for a pair. Only the
    pairs of shapes with more than ``AT_HAND`` contents are scored behind joins.
    """
    few = distinct.groupBy(*KEY, "param_fp").agg(F.count("*").alias("n")).filter(F.col("n") <= AT_HAND).select(*KEY, "param_fp")
    near = distinct.join(few, [*KEY, "param_fp"]).groupBy(*KEY, "param_fp").agg(F.collect_list(F.struct("near_fp", "codes")).alias("contents"))
    none = F.array().cast(near.schema["contents"].dataType)
    rows = shapes(distinct).drop("toks").join(near, [*KEY, "param_fp"], "left").withColumn("contents", F.coalesce("contents", none))
    met = stage(scored_pairs(rows.withColumnRenamed("param_fp", "id"), t, "shapes"), "bounded")
    side = lambda s: distinct.select(
        *KEY, F.col("param_fp").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("near_fp", "n_members", "rep")])
    scored = met.filter("similarity IS NOT NULL").join(side("a"), [*KEY, "id_a", "near_fp_a"]).join(side("b"), [*KEY, "id_b", "near_fp_b"])
    bare = met.filter("similarity IS NULL").select(*KEY, F.col("id_a").alias("param_fp_a"), F.col("id_b").alias("param_fp_b"))
    fetched = verify(bare, distinct, t)
    return scored.select(fetched.columns).unionByName(fetched)


def near_miss_join(frags: DataFrame, threshold: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Type-3 pairs of distinct contents with exact score and number of fragment pairs.

    Sides are ordered by their earliest members. ``n_pairs`` counts the fragment pairs
    that the row stands for, without those sharing lines of one file; rows that stand
    for none are dropped.
    """
    distinct = stage(contents(frags), "contents")
    return fragment_counts(near_miss_contents(distinct, tau(threshold)), frags)


def fragment_counts(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """Order the sides of verified content pairs and count the fragment pairs behind each.

    ``frags`` holds all fragments of the paired contents.
    """
    spot = lambda s: F.struct(*[F.col(f"rep_{s}.{c}") for c in PLACE])
    swap = spot("a") > spot("b")
    names = ("near_fp", "n_members", "rep")
    pairs = pairs.select(
        *KEY, "similarity",
        *[F.when(swap, F.col(f"{n}_b")).otherwise(F.col(f"{n}_a")).alias(f"{n}_a") for n in names],
        *[F.when(swap, F.col(f"{n}_a")).otherwise(F.col(f"{n}_b")).alias(f"{n}_b") for n in names],
    )
    inside = (
        overlapping_fragments(frags, "near_fp")
        .filter("language_a = language_b AND near_fp_a <> near_fp_b")
        .groupBy("job_id", F.col("language_a").alias("language"),
                 F.least("near_fp_a", "near_fp_b").alias("lo"), F.greatest("near_fp_a", "near_fp_b").alias("hi"))
        .agg(F.count("*").alias("overlapping"))
    )
    return (
        pairs.withColumn("lo", F.least("near_fp_a", "near_fp_b"))
        .withColumn("hi", F.greatest("near_fp_a", "near_fp_b"))
        .join(inside, [*KEY, "lo", "hi"], "left")
        .withColumn("n_pairs", (
            F.col("n_members_a").cast("decimal(19,0)") * F.col("n_members_b").cast("decimal(19,0)")
            - F.coalesce("overlapping", F.lit(0))).cast("decimal(38,0)"))
        .filter("n_pairs > 0")
        .drop("lo", "hi", "overlapping")
    )


def bag_overlap_join(rows: DataFrame, key: str, toks: str, t: float) -> DataFrame:
    """Pairs of rows whose weighted token bags overlap by at least ``t`` (Dice).

    Rows meet within job and language where they have these columns, block by block.
    """
    scope = [(F.col(k) if k in rows.columns else F.lit("all")).alias(k) for k in KEY]
    base = rows.select(*scope, F.col(key).alias("id"), X.token_codes(toks).alias("codes"))
    return matching_pairs(base, t, False, "bags").select(
        F.least("id_a", "id_b").alias(f"{key}_a"), F.greatest("id_a", "id_b").alias(f"{key}_b"), "shared",
        (2 * F.col("shared") / (F.col("weight_a") + F.col("weight_b"))).alias("overlap"))


def expand_near(near: DataFrame, frags: DataFrame, max_class: int | None = None) -> DataFrame:
    """Every fragment pair behind the near-miss rows.

    The members of both contents meet in blocks of fixed size, as copies do. With
    ``max_class`` a larger class fails the job; nothing is ever left out.
    """
    rows = near
    if max_class is not None:
        small = (F.col("n_members_a") <= max_class) & (F.col("n_members_b") <= max_class)
        rows = rows.filter(require(small, f"a class has more than {max_class} members: use the near-miss rows"))
    cols = ("frag_id", "file", *PLACE)
    pair = [*KEY, "near_fp_a", "near_fp_b", "n_members_a", "n_members_b", "similarity"]

    def member(s: str, o: str) -> DataFrame:
        side = frags.select(*KEY, F.col("near_fp").alias(f"near_fp_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols])
        return salted(
            rows.select(*pair).join(side, [*KEY, f"near_fp_{s}"]), f"frag_id_{s}", f"n_members_{s}", f"n_members_{o}", f"at_{s}", f"at_{o}")

    met = member("a", "b").join(
        member("b", "a").drop("n_members_a", "n_members_b", "similarity"), [*KEY, "near_fp_a", "near_fp_b", "at_a", "at_b"])
    met = met.filter(~X.overlaps("file_a", "start_line_a", "end_line_a", "file_b", "start_line_b", "end_line_b"))
    swap = F.struct(*[F.col(f"{c}_a") for c in PLACE]) > F.struct(*[F.col(f"{c}_b") for c in PLACE])
    pick = lambda c, s, o: F.when(swap, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}")
    return met.select(
        *KEY, F.lit("Type-3").alias("clone_type"), "similarity",
        *[pick(c, "a", "b") for c in cols], *[pick(c, "b", "a") for c in cols])
