"""Quality rules: robust multivariate outliers of document statistics, in SQL functions only.

Each document becomes a vector of five transformed statistics. Location and scatter of each
language and source come from the three quarters of its documents that lie closest together
(minimum covariance determinant): start from the language's medians, then let distances
choose the documents and the documents the estimates, a few times over. Small groups lean on
their language. A document far from its group by Mahalanobis distance is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspan.functions.text import let
from twinspan.llm.carried import Carried
from twinspan.operators.store import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Rules that need no estimate.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Share of a group's documents that an estimate rests on, and the factor that makes the
#: scatter of that share of a five-dimensional normal sample unbiased.
CORE = 0.75
CONSISTENCY = 1.41
C_STEPS = 3
#: A language's estimate counts as much as so many of a group's own documents.
PRIOR = 50.0
#: Standard deviations that no group falls below, the size of a measurement: five words in a
#: hundred, a letter in twenty words, six symbols in 1,400 characters, one repeated line in 35,
#: six repeated words in 600. Each lies below a fifth of what its statistic can reach.
FLOORS = (0.05, 0.05, 0.35, 0.25, 0.1)
#: The 0.99999 quantile of chi-squared with five degrees of freedom.
CUTOFF = 30.86
D = len(FLOORS)
X = [f"_x{i}" for i in range(D)]
KEYS = ["_lang", "_source"]
GROUP_SAMPLE = 1000


def _repeated_words(hashes: Column) -> Column:
    """Words in a window whose hash occurs again, from the hashes of all windows of three."""

    def from_sorted(s: Column) -> Column:
        n = F.size(s)
        again = lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == e["h"]))
        places = F.sort_array(F.transform(F.filter(s, again), lambda e: e["p"]))
        # Each place covers three words, fewer if the next follows closely.
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))),
            F.lit(0), lambda a, b: a + b))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, from_sorted))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and ``_lines``.

    A null text counts as empty and fails. ``docs`` must not have columns of these names.
    """
    body = F.coalesce(text, F.lit(""))
    # A generator of one row holds each array, so that later expressions read it and don't rebuild it.
    words = docs.withColumn("_words", F.explode(F.array(F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1)))))
    w = F.col("_words")
    triple = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    hashes = F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), triple)).otherwise(F.array().cast("array<bigint>"))
    counted = words.select(
        *docs.columns, F.size(w).cast("long").alias("n_words"),
        F.coalesce(F.length(F.array_join(w, "")), F.lit(0)).cast("long").alias("word_chars"),
        F.explode(F.array(hashes)).alias("_hashes"))
    lines = counted.select(
        *counted.columns[:-1], _repeated_words(F.col("_hashes")).cast("long").alias("n_repeat_words"),
        F.explode(F.array(F.filter(F.split(body, "\n", -1), lambda x: F.rlike(x, F.lit(WORD))))).alias("_texts"))
    return lines.select(
        *docs.columns, "n_words", "word_chars",
        F.regexp_count(body, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_texts") - F.size(F.array_distinct("_texts"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        F.size("_texts").cast("long").alias("_lines"))


def _vector() -> list[Column]:
    c = F.col
    n, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    return [
        F.log(n), c("word_chars") / n, F.log1p(100 * c("n_symbols") / chars),
        F.log1p(10 * c("n_dup_lines") / F.greatest(c("_lines"), F.lit(1))), F.sqrt(c("n_repeat_words") / n)]


def _pairs():
    return [(i, j) for i in range(D) for j in range(i + 1)]


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products of the vectors: all that mean and covariance need."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(X)],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"_q{i}{j}") for i, j in _pairs()])


def _moments(sums: DataFrame, prior: DataFrame | None, factor: float) -> DataFrame:
    """Means ``_m`` and covariances ``_c`` of groups, leaning on the language's."""
    if prior is None:
        mean = [F.col(f"_s{i}") / F.col("_n") for i in range(D)]
        cov = {(i, j): factor * (F.col(f"_q{i}{j}") / F.col("_n") - mean[i] * mean[j]) for i, j in _pairs()}
    else:
        total = F.col("_n") + PRIOR
        mean = [(F.col(f"_s{i}") + PRIOR * F.col(f"_pm{i}")) / total for i in range(D)]
        # The second moment about the mixed mean, of the group's rows and the prior's.
        cov = {(i, j): (factor * (F.col(f"_q{i}{j}") + PRIOR * F.col(f"_pm{i}") * F.col(f"_pm{j}") - total * mean[i] * mean[j])
                        + PRIOR * F.col(f"_pc{i}{j}")) / total for i, j in _pairs()}
        sums = sums.join(prior, "_lang")
    keys = [k for k in KEYS if k in sums.columns]
    return sums.select(*keys, *[m.alias(f"_m{i}") for i, m in enumerate(mean)], *[c.alias(f"_c{i}{j}") for (i, j), c in cov.items()])


def _whitened(moments: DataFrame) -> DataFrame:
    """Means and the inverse ``_w`` of the covariance's Cholesky factor.

    Floors are lower bounds of what a statistic varies by given those before it.
    """
    out = moments
    for i, j in _pairs():
        left = F.col(f"_c{i}{j}") - (_total([F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)]) if j else F.lit(0.0))
        if i == j:
            value = F.sqrt(F.greatest(left, F.lit(FLOORS[i] ** 2)))
        else:
            value = left / F.col(f"_l{j}{j}")
        out = out.withColumn(f"_l{i}{j}", value)
    for i in range(D):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"_l{i}{i}")
            else:
                value = -_total([F.col(f"_l{i}{k}") * F.col(f"_w{k}{j}") for k in range(j, i)]) / F.col(f"_l{i}{i}")
            out = out.withColumn(f"_w{i}{j}", value)
    keys = [k for k in KEYS if k in moments.columns]
    return out.select(*keys, *[f"_m{i}" for i in range(D)], *[f"_w{i}{j}" for i, j in _pairs()])


def _distance() -> Column:
    """Squared Mahalanobis distance of a row that carries its group's estimate."""
    return _total([F.pow(_total([F.col(f"_w{i}{j}") * (F.col(X[j]) - F.col(f"_m{j}")) for j in range(i + 1)]), 2) for i in range(D)])


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """Estimate per language and source from rows with ``_lang``, ``_source`` and the vector.

    Written once per step, so that a hot group's rows meet a table of one row per group and
    adaptive execution can split them.
    """
    # Start: the language's medians, spreads from the quartiles.
    at = lambda x: F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)
    start = vectors.groupBy("_lang").agg(*[at(x).alias(f"_a{i}") for i, x in enumerate(X)])
    spread = lambda i: F.greatest((F.col(f"_a{i}")[2] - F.col(f"_a{i}")[0]) / 1.349, F.lit(FLOORS[i]))
    start = stage(start.select(
        "_lang", *[F.col(f"_a{i}")[1].alias(f"_m{i}") for i in range(D)],
        *[(1 / spread(i) if i == j else F.lit(0.0)).alias(f"_w{i}{j}") for i, j in _pairs()]), "quality-start")
    estimate, on = start, ["_lang"]
    for step in range(C_STEPS):
        near = vectors.join(estimate, on).select(*KEYS, *X, _distance().alias("_d"))
        bound = stage(near.groupBy(*KEYS).agg(F.percentile_approx("_d", CORE, GROUP_SAMPLE).alias("_b")), f"quality-bound{step}")
        core = near.join(bound, KEYS).filter("_d <= _b")
        sums = stage(_sums(core, KEYS), f"quality-sums{step}")
        upper = sums.groupBy("_lang").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in KEYS])
        prior = _moments(upper, None, CONSISTENCY)
        prior = prior.select("_lang", *[F.col(c).alias(f"_p{c[1:]}") for c in prior.columns if c != "_lang"])
        estimate, on = stage(_whitened(_moments(sums, prior, CONSISTENCY)), f"quality-step{step}"), KEYS
    return estimate


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _judged(docs: Carried, columns: list[str]) -> DataFrame:
    """``columns`` under their carried names, the statistics and kept."""
    own = [docs.name(c) for c in columns]
    needed = dict.fromkeys([*own, *(docs.name(c) for c in ("text", "lang", "source"))])
    counted = with_statistics(docs.df.select(*needed), docs.name("text"))
    # A null language or source is a value of its own.
    key = lambda c: F.coalesce(F.concat(F.lit("="), docs.col(c).cast("string")), F.lit(""))
    rows = stage(counted.select(
        *own, *STATISTICS, key("lang").alias("_lang"), key("source").alias("_source"),
        *[v.alias(x) for v, x in zip(_vector(), X, strict=True)]), "quality-statistics")
    estimate = robust_estimates(rows.filter("NOT base_failed").select(*KEYS, *X))
    kept = ~F.col("base_failed") & F.coalesce(_distance() <= CUTOFF, F.lit(True))
    return rows.join(estimate, KEYS, "left").select(*own, *STATISTICS, kept.alias("kept"))


def judge(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with the statistics, base_failed and kept.

    Groups hold the documents that pass the base rules. Null languages and sources are
    values of their own. A group with no such document judges none. An empty table stays
    empty; repeated rows are judged alike; a column of ``docs`` that has a statistic's name
    plays no part.
    """
    held = Carried(docs)
    return _judged(held, columns).select(*held.back(columns), *STATISTICS, "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with the columns of ``docs``."""
    held = Carried(docs)
    return _judged(held, docs.columns).filter("kept").select(*held.back())
