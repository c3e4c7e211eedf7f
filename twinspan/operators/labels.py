"""Auditing labelled pairs: validation, leakage, contradictions, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import text as X
from twinspan.functions.numeric import require
from twinspan.operators.segment import once
from twinspan.operators.store import stage


def split_rank(split: str | Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in C.SPLITS]), X.col(split))


def validate_labeled(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reasons) of labelled pairs.

    Rows carry split, label, code_a, code_b and optionally ``_corrupt_record``. In
    strict mode the first bad row fails the job.
    """
    said = F.lit(False)
    if "_corrupt_record" in rows.columns:
        said = F.col("_corrupt_record").isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(f"^[{C.SPACE_CLASS}]*$")
    marked = rows
    for s in "ab":
        marked = once(marked, f"_toks_{s}", X.tokens(F.coalesce(F.col(f"code_{s}"), F.lit(""))))
        marked = once(marked, f"fp_{s}", X.fingerprint(f"_toks_{s}"))
        marked = marked.withColumn(f"short_{s}", F.size(f"_toks_{s}") < C.MIN_TOKENS).drop(f"_toks_{s}")
    bad_split = F.coalesce(~F.col("split").isin(*C.SPLITS), F.lit(True))
    bad_label = F.coalesce(~F.col("label").isin(0, 1), F.lit(True))
    reasons = F.array_compact(F.array(
        F.when(said, F.lit("invalid record")),
        F.when(~said & (bad_split | bad_label), F.lit("invalid split or label")),
        F.when(~said & (blank("code_a") | blank("code_b")), F.lit("empty code")),
        F.when(~said & (F.col("short_a") | F.col("short_b")), F.lit("fewer than three tokens")),
        F.when(~said & (F.col("fp_a") == F.col("fp_b")) & (F.col("label") == 0), F.lit("identical snippets labelled 0")),
    ))
    marked = marked.withColumn("reasons", F.explode(F.array(reasons))).drop("short_a", "short_b")
    if strict:
        marked = marked.filter(require(F.size("reasons") == 0, "invalid labelled pair"))
    # Both results come from one pass over the code.
    marked = stage(marked, "labeled")
    return marked.filter("size(reasons) = 0").drop("reasons"), marked.filter("size(reasons) > 0")


def endpoints(pairs: DataFrame) -> DataFrame:
    """(split, id) for both ends of every pair, repeats kept."""
    return pairs.select("split", F.explode(F.array("a_id", "b_id")).alias("id"))


def all_ids(pairs: DataFrame) -> DataFrame:
    return endpoints(pairs).select("id").distinct()


def unknown_ids(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """Ids used in pairs without a function of that id."""
    return all_ids(pairs).join(functions.select("id"), "id", "left_anti")


def split_audit(pairs: DataFrame) -> DataFrame:
    """Per split: pairs, distinct functions, references, and label counts."""
    ids = endpoints(pairs).groupBy("split").agg(
        F.count("*").alias("function_references"), F.countDistinct("id").alias("functions"))
    rows = pairs.groupBy("split").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"))
    return rows.join(ids, "split").withColumn("both_labels", (F.col("positive") > 0) & (F.col("negative") > 0))


def missing_labels(pairs: DataFrame, required: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Per split: required labels that never occur."""
    seen = pairs.groupBy("split").agg(*[F.max((F.col("label") == v).cast("int")).alias(f"_{v}") for v in required])
    absent = [F.when(F.coalesce(F.col(f"_{v}"), F.lit(0)) == 0, F.lit(v)) for v in required]
    return seen.select("split", F.array_compact(F.array(*absent)).alias("missing"))


def leakage(occurrences: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """Keys that occur in more than one split. At most three splits per key."""
    found = occurrences.groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("splits")).filter("size(splits) > 1")
    if strict:
        found = found.filter(require(F.lit(False), "function leakage between splits"))
    return found


def shared_ids(occurrences: DataFrame, left: str, right: str, key: str = "id") -> DataFrame:
    pick = lambda s: occurrences.filter(F.col("split") == s).select(key)
    return pick(left).intersect(pick(right))


def contradictory_pairs(pairs: DataFrame, across_splits: bool = True) -> DataFrame:
    """Unordered pairs that carry both labels."""
    keys = [F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi")]
    by = keys if across_splits else ["split", *keys]
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("label").alias("lo_label"), F.max("label").alias("hi_label")
    ).filter("lo_label <> hi_label").drop("lo_label", "hi_label")


def dedupe_pairs(pairs: DataFrame, keep: str = "last", ordinal: str = "ordinal") -> DataFrame:
    """One row per split and unordered pair: the first or last by ``ordinal``."""
    pick = F.max_by if keep == "last" else F.min_by
    row = F.struct(*pairs.columns)
    return pairs.groupBy("split", F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi")).agg(
        pick(row, ordinal).alias("r")).select("r.*")


def first_owner(functions: DataFrame, fp: str = "fp") -> DataFrame:
    """Keep a token sequence in the first split that has it; same-split repeats stay.

    The owner is an aggregate per fingerprint, written and joined back: both sides of the
    join are scans, so adaptive execution can split a sequence repeated millions of times.
    """
    owner = stage(functions.groupBy(fp).agg(F.min(split_rank("split")).alias("owner")), "owners")
    return functions.join(owner, fp).withColumn("kept", split_rank("split") == F.col("owner")).drop("owner")


def sample_functions(occurrences: DataFrame, limits: dict[str, int], seed: int) -> DataFrame:
    """Label-blind sample of distinct ids per split; 0 takes all.

    The draw is the lowest hashes of (id, seed). Counts per leading bits of the hash tell
    which of 65,536 cells are taken whole; only the one cell in which a split's limit falls
    is sorted.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    ids = occurrences.select("split", "id").distinct().withColumn("draw", draw).withColumn(
        "cell", F.conv(F.substring("draw", 1, 4), 16, 10).cast("int"))
    ids = stage(ids.filter(F.col("split").isin(*limits)), "draws")
    # At most 65,536 rows per split come to the driver.
    sizes: dict[str, dict[int, int]] = {s: {} for s in limits}
    for r in ids.groupBy("split", "cell").count().collect():
        sizes[r["split"]][r["cell"]] = r["count"]
    out = ids.limit(0)
    for split, n in limits.items():
        mine = ids.filter(F.col("split") == split)
        left, last = n, -1
        for cell in sorted(sizes[split]):
            if sizes[split][cell] > left:
                last = cell
                break
            left -= sizes[split][cell]
        if not n or last < 0:
            out = out.unionByName(mine)
            continue
        rest = mine.filter(F.col("cell") == last).orderBy("draw", "id").limit(left)
        out = out.unionByName(mine.filter(F.col("cell") < last)).unionByName(rest)
    return out.drop("draw", "cell")


def induced_rows(pairs: DataFrame, selected: DataFrame, eligible: DataFrame) -> DataFrame:
    """Pairs whose two ends are selected in the split and eligible, repeats kept, no pair of an id with itself."""
    ids = selected.select("split", "id").join(eligible.select("id"), "id", "left_semi")
    kept = pairs.filter("a_id <> b_id")
    for s in "ab":
        kept = kept.join(ids.select("split", F.col("id").alias(f"{s}_id")), ["split", f"{s}_id"], "left_semi")
    return kept


def induced_pairs(pairs: DataFrame, selected: DataFrame, eligible: DataFrame) -> DataFrame:
    """The last of each unordered pair among ``induced_rows``."""
    return dedupe_pairs(induced_rows(pairs, selected, eligible), "last")


def label_join(frags: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return frags.join(labels, key)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
