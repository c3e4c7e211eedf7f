"""Vector, score and statistics expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions.text import ColumnLike, col, let


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(v: ColumnLike) -> Column:
    return F.sqrt(_dot(col(v), col(v)))


def unit_vector(v: ColumnLike) -> Column:
    return let(
        norm(v), lambda n: F.transform(col(v), lambda x: x.cast("double") / n)
    )


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Cosine of two vectors, clipped to [-1, 1]."""
    raw = _dot(col(a), col(b)) / (norm(a) * norm(b))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def cosine_of_units(a: ColumnLike, b: ColumnLike) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(col(a), col(b))))


def valid_vector(v: ColumnLike, dim: int) -> Column:
    """Right length, all finite, not (nearly) zero."""
    c = col(v)
    finite = F.forall(
        c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce(
        (F.size(c) == dim) & F.coalesce(finite, F.lit(False)) & (norm(c) > 1e-9),
        F.lit(False),
    )


def valid_score(s: ColumnLike, low: float = 0.0, high: float = 1.0) -> Column:
    c = col(s)
    return F.coalesce(~F.isnan(c) & (c >= low) & (c <= high), F.lit(False))


def require(condition: Column, message: str) -> Column:
    """A filter condition that fails the job instead of dropping the row.

    Use it in ``filter``: there the optimizer cannot prune it away, whereas an unused
    column holding the same check would never run.
    """
    return F.when(condition, F.lit(True)).otherwise(
        F.raise_error(F.lit(message)).cast("boolean")
    )


def wilson_lower(successes: ColumnLike, n: ColumnLike, z: float = C.WILSON_Z) -> Column:
    """Lower Wilson bound of a proportion; 0 without observations."""
    k = col(successes).cast("double")
    m = F.when(col(n) > 0, col(n).cast("double"))
    p = k / m
    centre = p + z * z / (2 * m)
    spread = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.coalesce((centre - spread) / (1 + z * z / m), F.lit(0.0))


def clamp_threshold(t: ColumnLike) -> Column:
    low, high = C.THRESHOLD_RANGE
    return F.greatest(F.lit(low), F.least(F.lit(high), col(t)))


def pct(x: ColumnLike) -> Column:
    """A share as a whole percentage, halves upwards."""
    return F.floor(F.coalesce(col(x), F.lit(0.0)) * 100 + 0.5).cast("int")


def round6(x: ColumnLike) -> Column:
    return F.round(col(x), 6)


def pair_features(a: ColumnLike, b: ColumnLike) -> Column:
    """|a-b| followed by a*b: the same whichever side comes first."""
    return F.concat(
        F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
    )


def semantic_cutoffs(threshold: ColumnLike, classifier_threshold: ColumnLike, mode: ColumnLike) -> Column:
    """struct(semantic_threshold, corroborated_threshold, effective) for a mode."""
    t, m = col(threshold), col(mode)
    head = F.greatest(
        t, F.lit(C.TYPE4_CLASSIFIER_CUTOFF), F.coalesce(col(classifier_threshold), F.lit(0.0))
    )
    reported = F.when(m == "classifier", head).when(
        m == "embedding", F.greatest(t, F.lit(C.TYPE4_EMBEDDING_CUTOFF))
    )
    corroborated = F.when(
        m == "embedding", F.greatest(t, F.lit(C.TYPE4_CORROBORATED_CUTOFF))
    )
    return F.struct(
        reported.alias("semantic_threshold"),
        corroborated.alias("corroborated_threshold"),
        F.least(reported, F.coalesce(corroborated, reported)).alias("effective"),
    )
