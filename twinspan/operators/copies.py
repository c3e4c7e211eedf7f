"""Exact copies (Type-1) and consistently renamed copies (Type-2).

Equal content is an equivalence, so the result is kept as classes: one row per class,
one row per member, and exact pair totals by arithmetic. n copies cost n rows here,
not n(n-1)/2. Pairs are listed on request, for classes of a checked size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import text as X
from twinspan.functions.numeric import require
from twinspan.functions.renaming import rename_identifiers
from twinspan.operators.segment import once
from twinspan.operators.store import stage

CLASS_KEY = {"tokens": "token_fp", "params": "param_fp", "near": "near_fp"}
PLACE = ["file_ord", "start_line", "end_line"]


def fingerprints(frags: DataFrame) -> DataFrame:
    """Add params, near, and the three fingerprints to tokenised fragments."""
    renamed = once(
        frags.withColumn("params", rename_identifiers("tokens")),
        "near", X.near_miss_tokens("tokens", "params"),
    )
    return (
        renamed.withColumn("token_fp", X.fingerprint("tokens"))
        .withColumn("param_fp", X.fingerprint("params"))
        .withColumn("near_fp", X.fingerprint("near"))
    )


def place() -> Column:
    """Total order of fragments: upload order of the file, then lines."""
    return F.struct(*PLACE)


def clone_classes(frags: DataFrame, level: str = "tokens") -> DataFrame:
    """Groups of fragments of one job and language with equal content.

    One row per class with its size, number of files and earliest member. Partial
    aggregation runs before the shuffle, so a hot class costs one row per task.
    """
    fp = CLASS_KEY[level]
    return (
        frags.groupBy("job_id", "language", fp)
        .agg(
            F.count("*").alias("n_members"),
            F.min_by(F.struct("frag_id", "file", *PLACE), place()).alias("anchor"),
        )
        .filter("n_members > 1")
    )


def class_members(frags: DataFrame, level: str = "tokens") -> DataFrame:
    """Each member of a class with its anchor, the earliest member.

    The classes are written first: with a scan on both sides of the join, a hot key is
    split by adaptive skew handling, which copies its one class row to many tasks.
    """
    fp = CLASS_KEY[level]
    return (
        frags.join(stage(clone_classes(frags, level), "classes"), ["job_id", "language", fp])
        .withColumn("is_anchor", F.col("frag_id") == F.col("anchor.frag_id"))
        .withColumn(
            "overlaps_anchor",
            ~F.col("is_anchor") & X.overlaps(
                "file", "start_line", "end_line",
                "anchor.file", "anchor.start_line", "anchor.end_line"),
        )
    )


def overlapping_fragments(frags: DataFrame, *carry: str) -> DataFrame:
    """Pairs of fragments of one file that share lines; these are never compared.

    Fragments are put in line buckets as long as a window, so they meet only their
    neighbours, and each pair is kept in the bucket where its later start lies.
    """
    size = C.WINDOW_LINES
    cols = ["job_id", "language", "file", "frag_id", "start_line", "end_line", *carry]
    rows = frags.select(*cols).withColumn(
        "bucket",
        F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size))),
    )
    a = rows.select("job_id", "file", "bucket", *[F.col(c).alias(c + "_a") for c in cols if c not in ("job_id", "file")])
    b = rows.select("job_id", "file", "bucket", *[F.col(c).alias(c + "_b") for c in cols if c not in ("job_id", "file")])
    earlier = F.struct("start_line_a", "end_line_a") < F.struct("start_line_b", "end_line_b")
    meet = (F.col("end_line_a") >= F.col("start_line_b")) & earlier
    once_only = F.col("bucket") == F.floor(F.col("start_line_b") / size)
    return a.join(b, ["job_id", "file", "bucket"]).filter(meet & once_only).drop("bucket")


def _choose2(n: str) -> Column:
    """n(n-1)/2, exact beyond what a LONG holds."""
    return (F.col(n).cast("decimal(19,0)") * (F.col(n) - 1).cast("decimal(19,0)") / 2).cast("decimal(38,0)")


def candidate_pair_count(frags: DataFrame) -> DataFrame:
    """Per job: how many pairs a comparison of everything with everything would have.

    n(n-1)/2 less the overlapping pairs; nothing is enumerated.
    """
    total = frags.groupBy("job_id").agg(F.count("*").alias("n")).select(
        "job_id", _choose2("n").alias("all_pairs"))
    inside = overlapping_fragments(frags).groupBy("job_id").agg(F.count("*").alias("overlapping"))
    return total.join(inside, "job_id", "left").select(
        "job_id", (F.col("all_pairs") - F.coalesce("overlapping", F.lit(0))).alias("candidate_pairs"))


def copy_pair_totals(frags: DataFrame) -> DataFrame:
    """Per job: exact numbers of Type-1 and Type-2 pairs, without listing a pair.

    Type-2 is all pairs of a renaming class less those of its exact classes. One
    shuffle serves both: exact classes are folded into their renaming class.
    """
    exact = frags.groupBy("job_id", "language", "param_fp", "token_fp").agg(F.count("*").alias("n"))
    renamed = exact.groupBy("job_id", "language", "param_fp").agg(
        F.sum("n").alias("n"), F.sum(_choose2("n")).alias("type1"))
    per_job = renamed.groupBy("job_id").agg(
        F.sum("type1").alias("type1"), F.sum(_choose2("n")).alias("upto2"))
    same = overlapping_fragments(frags, "token_fp", "param_fp").filter(
        "language_a = language_b AND param_fp_a = param_fp_b")
    minus = same.groupBy("job_id").agg(
        F.count_if(F.col("token_fp_a") == F.col("token_fp_b")).alias("o1"),
        F.count_if(F.col("token_fp_a") != F.col("token_fp_b")).alias("o2"))
    zero = F.lit(0)
    return per_job.join(minus, "job_id", "left").select(
        "job_id",
        (F.col("type1") - F.coalesce("o1", zero)).alias("type1_pairs"),
        (F.col("upto2") - F.col("type1") - F.coalesce("o2", zero)).alias("type2_pairs"),
    )


def copy_pairs_by_file(frags: DataFrame) -> DataFrame:
    """Per file: exact numbers of Type-1 and Type-2 pairs that touch it.

    A pair inside one file counts once. A file with k of the n members of a class
    touches k(2n - k - 1)/2 pairs; pairs sharing lines are taken off.
    """
    touched = lambda n, k: (
        F.col(k).cast("decimal(19,0)") * (2 * F.col(n) - F.col(k) - 1).cast("decimal(19,0)") / 2).cast("decimal(38,0)")
    here = frags.groupBy("job_id", "language", "param_fp", "token_fp", "file").agg(F.count("*").alias("k"))

    def counts(key: list[str], name: str) -> DataFrame:
        # Both sides are written, so that a hot class can be split in the join.
        mine = stage(here.groupBy(*key, "file").agg(F.sum("k").alias("k")), f"files-{name}")
        size = stage(mine.groupBy(*key).agg(F.sum("k").alias("n")).filter("n > 1"), f"sizes-{name}")
        return mine.join(size, key).groupBy("job_id", "file").agg(F.sum(touched("n", "k")).alias(name))

    base = ["job_id", "language"]
    upto2 = counts([*base, "param_fp"], "upto2")
    type1 = counts([*base, "token_fp"], "type1")
    inside = overlapping_fragments(frags, "token_fp", "param_fp").filter(
        "language_a = language_b AND param_fp_a = param_fp_b").groupBy("job_id", "file").agg(
        F.count_if(F.col("token_fp_a") == F.col("token_fp_b")).alias("o1"),
        F.count_if(F.col("token_fp_a") != F.col("token_fp_b")).alias("o2"))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = upto2.join(type1, ["job_id", "file"], "left").join(inside, ["job_id", "file"], "left").select(
        "job_id", "file", (z("type1") - z("o1")).alias("type1_pairs"),
        (F.col("upto2") - z("type1") - z("o2")).alias("type2_pairs"))
    return out.filter("type1_pairs + type2_pairs > 0")


_SIDE = ["frag_id", "file", "language", *PLACE]


def copy_links(frags: DataFrame) -> DataFrame:
    """A spanning set of Type-1 and Type-2 pairs, at most one row per fragment.

    Every member of an exact class is linked to the class anchor (Type-1); the anchor
    of every exact class is linked to the anchor of its renaming class (Type-2). Any
    other pair follows: two members of one renaming class are a Type-1 pair when
    their token fingerprints agree and a Type-2 pair when they do not.
    """
    cols = [c for c in _SIDE if c != "language"]
    flat = [F.col(f"a.{c}").alias(f"{c}_a") for c in cols]
    here = [f"{c}_a" for c in cols]
    # Flat and written: a hot class meets its one row in a join of two scans.
    exact = stage(frags.groupBy("job_id", "language", "param_fp", "token_fp").agg(
        F.count("*").alias("n_members"), F.min_by(F.struct(*cols), place()).alias("a")).select(
        "job_id", "language", "param_fp", "token_fp", "n_members", *flat), "exact-classes")
    renamed = stage(exact.groupBy("job_id", "language", "param_fp").agg(
        F.count("*").alias("n_members"),
        F.min_by(F.struct(*[F.col(f"{c}_a").alias(c) for c in cols]), F.struct(*[f"{c}_a" for c in PLACE])).alias("a"),
    ).filter("n_members > 1").select("job_id", "language", "param_fp", *flat), "renamed-classes")
    type1 = frags.select("job_id", "language", "token_fp", *[F.col(c).alias(f"{c}_b") for c in cols]).join(
        exact.filter("n_members > 1").select("job_id", "language", "token_fp", *here), ["job_id", "language", "token_fp"])
    type2 = exact.select("job_id", "language", "param_fp", *[F.col(f"{c}_a").alias(f"{c}_b") for c in cols]).join(
        renamed, ["job_id", "language", "param_fp"])
    out = ["job_id", "language", *here, *[f"{c}_b" for c in cols]]
    both = type1.select(*out, F.lit("Type-1").alias("clone_type")).unionByName(type2.select(*out, F.lit("Type-2").alias("clone_type")))
    return both.filter("frag_id_a <> frag_id_b").select(
        "job_id", "language", "clone_type", *here, *[f"{c}_b" for c in cols],
        X.overlaps("file_a", "start_line_a", "end_line_a", "file_b", "start_line_b", "end_line_b").alias("overlapping"),
        F.lit(1.0).alias("similarity"),
    )


# Members of a class, on one side, that one task pairs with as many on the other.
BLOCK = 2000


def salted(rows: DataFrame, own: str, size_own: str, size_other: str, here: str, there: str) -> DataFrame:
    """Deal a side of a class join into blocks: a row's own block, and all blocks of the other side."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    return rows.withColumn(here, F.pmod(F.xxhash64(own), blocks(size_own)).cast("int")).withColumn(
        there, F.explode(F.sequence(F.lit(0), blocks(size_other) - 1)))


def expand_pairs(frags: DataFrame, max_class: int | None = None) -> DataFrame:
    """Every Type-1 and Type-2 pair.

    The output is quadratic in a class. Both sides are dealt into blocks by the size of
    the class, so that a task makes at most ``BLOCK`` squared pairs of a class at a time. With
    ``max_class`` a larger class fails the job; nothing is ever left out.
    """
    sizes = frags.groupBy("job_id", "language", "param_fp").agg(F.count("*").alias("n")).filter("n > 1")
    if max_class is not None:
        sizes = sizes.filter(require(
            F.col("n") <= max_class,
            f"a class has more than {max_class} members: use clone_classes and copy_pair_totals"))
    sizes = stage(sizes, "class-sizes")
    rows = frags.select("job_id", "language", "param_fp", "token_fp", F.struct(*_SIDE).alias("f")).join(
        sizes.select("job_id", "language", "param_fp", "n"), ["job_id", "language", "param_fp"])
    key = ["job_id", "language", "param_fp", "at_a", "at_b"]
    a = salted(rows, "f.frag_id", "n", "n", "at_a", "at_b").select(*key, F.col("f").alias("a"), F.col("token_fp").alias("fp_a"))
    b = salted(rows, "f.frag_id", "n", "n", "at_b", "at_a").select(*key, F.col("f").alias("b"), F.col("token_fp").alias("fp_b"))
    order = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in PLACE])
    disjoint = ~X.overlaps("a.file", "a.start_line", "a.end_line", "b.file", "b.start_line", "b.end_line")
    return a.join(b, key).filter((order("a") < order("b")) & disjoint).select(
        "job_id", "language",
        F.when(F.col("fp_a") == F.col("fp_b"), "Type-1").otherwise("Type-2").alias("clone_type"),
        *[F.col(f"a.{c}").alias(f"{c}_a") for c in _SIDE if c != "language"],
        *[F.col(f"b.{c}").alias(f"{c}_b") for c in _SIDE if c != "language"],
        F.lit(1.0).alias("similarity"),
    )


def union_typed(*frames: DataFrame) -> DataFrame:
    """Union of disjoint frames of typed pairs."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
