"""Summaries of clone pairs and of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.functions import text as X
from twinspan.functions.numeric import pct


def type_column(clone_type: str) -> str:
    return clone_type.lower().replace("-", "") + "_count"


def type_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """Pairs per type, zero-filled, in one partial aggregation."""
    return pairs.groupBy(*(by or ("job_id",))).agg(
        F.count("*").alias("total_pairs"),
        *[F.count_if(F.col("clone_type") == t).alias(type_column(t)) for t in C.CLONE_TYPES],
    )


def dashboard_stats(jobs: DataFrame, *by: str) -> DataFrame:
    """Totals over finished jobs; ``avg_f1`` is measured elsewhere and stays null."""
    done = jobs.filter(F.col("status") == "done")
    counts = [type_column(t) for t in C.CLONE_TYPES]
    totals = done.groupBy(*by).agg(
        F.count("*").alias("total_jobs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_pairs", "total_fragments", *counts)],
    )
    return totals.select(
        *by, "total_jobs", "total_pairs", "total_fragments",
        F.lit(None).cast("double").alias("avg_f1"),
        F.map_from_arrays(
            F.array(*[F.lit(t) for t in C.CLONE_TYPES]), F.array(*counts)
        ).alias("type_distribution"),
    )


def type_distribution_pct(pairs: DataFrame, *by: str) -> DataFrame:
    """Share of each type, as a fraction and a whole percentage; empty without pairs."""
    counts = pairs.groupBy(*by, "clone_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("n") / total).withColumn("percent", pct("share"))


def files_with_clones(pairs: DataFrame) -> DataFrame:
    """Per file: pairs touching it and their types. A pair inside one file counts once."""
    sides = F.array_distinct(F.array(
        F.translate("file_a", "\\", "/"), F.translate("file_b", "\\", "/")))
    parts = X.path_parts("file")
    return (
        pairs.select("job_id", "clone_type", F.explode(sides).alias("file"))
        .filter("file IS NOT NULL AND file <> ''")
        .groupBy("job_id", "file")
        .agg(F.count("*").alias("clone_count"), F.sort_array(F.collect_set("clone_type")).alias("types"))
        .select("job_id", "file", parts["name"].alias("name"), parts["dir"].alias("dir"),
                parts["ext"].alias("ext"), "clone_count", "types")
    )


def top_files(file_summary: DataFrame) -> DataFrame:
    return file_summary.orderBy(F.desc("clone_count"), "file")


def diagnostics(pairs: DataFrame) -> DataFrame:
    """One message per region: both sides of a pair, even within one file."""
    sides = F.array(*[
        F.struct(F.col(f"file_{s}").alias("file"), F.col(f"start_line_{s}").alias("start_line"),
                 F.col(f"end_line_{s}").alias("end_line")) for s in "ab"])
    return pairs.select(
        "job_id", F.explode(sides).alias("r"),
        F.concat("clone_type", F.lit(": "), pct("similarity").cast("string"), F.lit("% similar code")).alias("message"),
    ).select("job_id", "r.*", "message")


def diagnostics_by_file(pairs: DataFrame) -> DataFrame:
    return diagnostics(pairs).groupBy("job_id", "file").agg(
        F.count("*").alias("n_messages"), F.min("start_line").alias("first_line"),
        F.max("end_line").alias("last_line"))


def pair_flags(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("same_file", F.col("file_a") == F.col("file_b")).withColumn(
        "cross_language", F.col("language_a") != F.col("language_b"))


def filter_pairs(pairs: DataFrame, clone_type: str | None = None, file: str | None = None) -> DataFrame:
    if clone_type is not None:
        pairs = pairs.filter(F.col("clone_type") == clone_type)
    if file is not None:
        wanted = X.normalise_path(F.lit(file))
        pairs = pairs.filter((X.normalise_path("file_a") == wanted) | (X.normalise_path("file_b") == wanted))
    return pairs


PAIR_ORDER = ("file_a", "file_b", "start_line_a", "end_line_a", "start_line_b", "end_line_b")


def pair_order() -> list[Column]:
    return [(F.col("clone_type") == "Type-4").desc(), F.desc("similarity"), *[F.col(c) for c in PAIR_ORDER]]


def order_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(*pair_order())


def first_pair(pairs: DataFrame, *by: str) -> DataFrame:
    """The leading pair of each job in display order, by a combinable aggregate."""
    rank = F.struct(
        (F.col("clone_type") != "Type-4").alias("r"), (-F.col("similarity")).alias("s"), *PAIR_ORDER)
    keep = F.struct("clone_type", "similarity", *PAIR_ORDER)
    return pairs.groupBy(*(by or ("job_id",))).agg(F.min_by(keep, rank).alias("p")).select(*(by or ("job_id",)), "p.*")


def region_report(pairs: DataFrame) -> DataFrame:
    """The seven export columns; ranges as start-end."""
    rng = lambda s: F.concat_ws("-", f"start_line_{s}", f"end_line_{s}")
    return pairs.select(
        "file_a", rng("a").alias("lines_a"), "file_b", rng("b").alias("lines_b"),
        F.col("clone_type").alias("type"), "similarity", "cross_language")


# --- jobs --------------------------------------------------------------------


def owned_by(jobs: DataFrame, user_id) -> DataFrame:
    return jobs.filter(F.col("user_id") == user_id)


def recent_jobs(jobs: DataFrame, n: int = C.RECENT_JOBS) -> DataFrame:
    """Latest jobs first; the limit is the feature. Runs as a distributed top-n."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def job_list(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with the number of their files and the first path.

    Child rows are reduced before the join; the full list of a job's files is
    ``files`` filtered by the job, as rows.
    """
    per_job = files.groupBy("job_id").agg(F.count("*").alias("n_files"), F.min("file").alias("first_file"))
    return jobs.join(per_job, "job_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def job_detail(jobs: DataFrame, files: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per job with file and pair summaries; children are reduced first, so
    nothing fans out. The pairs themselves stay rows of ``pairs``."""
    pair_side = type_counts(pairs).drop("total_pairs").join(
        pairs.groupBy("job_id").agg(F.count("*").alias("total_pairs"), F.max("similarity").alias("top_similarity")),
        "job_id")
    zero = ["n_files", "total_pairs", *[type_column(t) for t in C.CLONE_TYPES]]
    return job_list(jobs, files).join(pair_side, "job_id", "left").fillna(0, subset=zero)


def delete_job(tables: dict[str, DataFrame], job_id, user_id) -> dict[str, DataFrame]:
    """All tables without the rows of one owned job; others' jobs are untouched."""
    doomed = tables["jobs"].filter(
        (F.col("job_id") == job_id) & (F.col("user_id") == user_id)).select("job_id")
    return {name: t.join(doomed, "job_id", "left_anti") for name, t in tables.items()}


def latest_progress(events: DataFrame) -> DataFrame:
    """Last event of each job, by time; a combinable aggregate, no sort."""
    rest = [c for c in events.columns if c != "job_id"]
    return events.groupBy("job_id").agg(
        F.max_by(F.struct(*rest), F.struct("ts", "stage")).alias("e")).select("job_id", "e.*")


def job_position(status: str | Column, stage: str | Column) -> Column:
    """struct(stage, step, percent); step -1 and 0 percent for an unknown stage."""
    s = X.col(status)
    shown = F.when(s == "done", "complete").when(s == "queued", "queued").otherwise(X.col(stage))
    step = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in C.STAGES]), shown), F.lit(0)) - 1
    percent = F.when(step < 0, F.lit(0.0)).otherwise(step / F.lit(len(C.STAGES) - 1) * 100)
    return F.struct(shown.alias("stage"), step.cast("int").alias("step"), percent.alias("percent"))


def analysis_info_json(info: Column) -> Column:
    return F.to_json(info, {"ignoreNullFields": "false"})
