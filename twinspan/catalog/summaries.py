"""Roll-ups of pairs and jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.catalog import common as B
from twinspan.functions import numeric as N
from twinspan.operators import rollups as R
from twinspan.session import checkpoint_dir
from twinspan.sources.job_tables import JobTables

FP = f"WITH {B.SQL_FILE_PAIRS}"
COUNTS = ", ".join(f"count(*) FILTER (clone_type = '{t}') AS {R.type_column(t)}" for t in C.CLONE_TYPES)
ORDER = "clone_type <> 'Type-4', -similarity, file_a, file_b, start_line_a, end_line_a, start_line_b, end_line_b"


def progress(spark, sf):
    return as_progress(B.table(spark, sf, "events"))


def as_progress(e):
    return e.select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("stage"), F.col("event_id").alias("n"))


def register(r: B.Registry) -> None:
    r.add("type_counts", lambda spark, sf: R.type_counts(B.file_pairs(spark, sf)),
          f"{FP} SELECT job_id, count(*) AS total_pairs, {COUNTS} FROM pairs GROUP BY job_id")

    def stats(spark, sf):
        s = R.dashboard_stats(B.jobs(spark, sf), "user_id")
        return s.select("user_id", "total_jobs", "total_pairs", "total_fragments", "avg_f1",
                        *[F.col("type_distribution")[t].alias(R.type_column(t)) for t in C.CLONE_TYPES])

    r.add("dashboard_stats", stats, f"""WITH {B.SQL_JOBS} SELECT user_id, count(*) AS total_jobs, CAST(sum(total_pairs) AS BIGINT) AS total_pairs,
        CAST(sum(total_fragments) AS BIGINT) AS total_fragments, CAST(NULL AS DOUBLE) AS avg_f1,
        {", ".join(f"CAST(sum({R.type_column(t)}) AS BIGINT) AS {R.type_column(t)}" for t in C.CLONE_TYPES)}
        FROM jobs WHERE status = 'done' GROUP BY user_id""")

    r.add("type_distribution_pct", lambda spark, sf: R.type_distribution_pct(B.file_pairs(spark, sf), "job_id").select(
        "job_id", "clone_type", "n", F.round("share", 6).alias("share"), "percent"),
        f"""{FP}, c AS (SELECT job_id, clone_type, count(*) AS n FROM pairs GROUP BY ALL),
            s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY job_id) AS DOUBLE) AS share FROM c)
            SELECT job_id, clone_type, n, round(share, 6) AS share, CAST(floor(share * 100 + 0.5) AS INTEGER) AS percent FROM s""")

    sides = f"""{FP}, s AS (SELECT job_id, clone_type, unnest(list_distinct([file_a, file_b])) AS file FROM pairs)"""
    r.add("files_with_clones", lambda spark, sf: R.files_with_clones(B.file_pairs(spark, sf)).withColumn("types", F.array_join("types", ",")),
          f"""{sides} SELECT job_id, file, split_part(file, '/', -1) AS name, regexp_extract(file, '^(.*/)?[^/]*$', 1) AS dir, 'TXT' AS ext,
              count(*) AS clone_count, string_agg(DISTINCT clone_type, ',' ORDER BY clone_type) AS types FROM s GROUP BY job_id, file""")
    r.add("top_files", lambda spark, sf: R.top_files(R.files_with_clones(B.file_pairs(spark, sf))).select("job_id", "file", "clone_count"),
          f"{sides} SELECT job_id, file, count(*) AS clone_count FROM s GROUP BY job_id, file ORDER BY clone_count DESC, file")

    r.add("diagnostics", lambda spark, sf: R.diagnostics(B.file_pairs(spark, sf)),
          f"""{FP} SELECT job_id, file_a AS file, start_line_a AS start_line, end_line_a AS end_line,
                clone_type || ': ' || CAST(floor(similarity * 100 + 0.5) AS INTEGER) || '% similar code' AS message FROM pairs
              UNION ALL SELECT job_id, file_b, start_line_b, end_line_b,
                clone_type || ': ' || CAST(floor(similarity * 100 + 0.5) AS INTEGER) || '% similar code' FROM pairs""")
    r.add("diagnostics_by_file", lambda spark, sf: R.diagnostics_by_file(B.file_pairs(spark, sf)),
          f"""{FP}, d AS (SELECT job_id, file_a AS file, start_line_a AS s, end_line_a AS e FROM pairs
                          UNION ALL SELECT job_id, file_b, start_line_b, end_line_b FROM pairs)
              SELECT job_id, file, count(*) AS n_messages, min(s) AS first_line, max(e) AS last_line FROM d GROUP BY job_id, file""")

    r.add("pair_flags", lambda spark, sf: R.pair_flags(B.file_pairs(spark, sf)).select("id_a", "id_b", "same_file", "cross_language"),
          f"{FP} SELECT id_a, id_b, file_a = file_b AS same_file, language_a <> language_b AS cross_language FROM pairs")
    r.add("filter_pairs", lambda spark, sf: R.filter_pairs(B.file_pairs(spark, sf), "Type-2").select("file_a", "file_b"),
          f"{FP} SELECT file_a, file_b FROM pairs WHERE clone_type = 'Type-2'")
    r.add("order_pairs", lambda spark, sf: R.order_pairs(B.file_pairs(spark, sf)).select("file_a", "file_b", "clone_type", "similarity"),
          f"{FP} SELECT file_a, file_b, clone_type, similarity FROM pairs ORDER BY {ORDER}")
    r.add("first_pair", lambda spark, sf: R.first_pair(B.file_pairs(spark, sf)).select("job_id", "clone_type", "similarity", "file_a", "file_b"),
          f"""{FP} SELECT job_id, clone_type, similarity, file_a, file_b FROM
              (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {ORDER}) AS k FROM pairs) WHERE k = 1""")
    r.add("export_csv", lambda spark, sf: R.region_report(B.file_pairs(spark, sf)),
          f"""{FP} SELECT file_a, start_line_a || '-' || end_line_a AS lines_a, file_b, start_line_b || '-' || end_line_b AS lines_b,
              clone_type AS type, similarity, cross_language FROM pairs""")

    # --- jobs
    r.add("owned_by", lambda spark, sf: R.owned_by(B.jobs(spark, sf), 7).select("job_id", "status"),
          f"WITH {B.SQL_JOBS} SELECT job_id, status FROM jobs WHERE user_id = 7")
    r.add("done_only", lambda spark, sf: B.jobs(spark, sf).filter("status = 'done'").select("job_id"),
          f"WITH {B.SQL_JOBS} SELECT job_id FROM jobs WHERE status = 'done'")
    r.add("recent_jobs", lambda spark, sf: R.recent_jobs(B.jobs(spark, sf)).select("job_id", "user_id", "status"),
          f"WITH {B.SQL_JOBS} SELECT job_id, user_id, status FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 8")
    r.add("job_list", lambda spark, sf: R.job_list(B.jobs(spark, sf), B.job_files(spark, sf)).select("job_id", "user_id", "status", "n_files", "first_file"),
          f"""WITH {B.SQL_JOBS}, {B.SQL_JOB_FILES} SELECT j.job_id, user_id, status, count(f.job_id) AS n_files, min(file) AS first_file
              FROM jobs j LEFT JOIN job_files f USING (job_id) GROUP BY j.job_id, user_id, status""")
    r.add("job_detail", lambda spark, sf: R.job_detail(
        B.jobs(spark, sf).drop("total_pairs", "type1_count", "type2_count", "type3_count", "type4_count"),
        B.job_files(spark, sf), B.job_pairs(spark, sf)).drop("created_at", "total_fragments"),
        f"""WITH {B.SQL_JOBS}, {B.SQL_JOB_FILES}, {B.SQL_JOB_PAIRS},
            f AS (SELECT job_id, count(*) AS n_files, min(file) AS first_file FROM job_files GROUP BY job_id),
            p AS (SELECT job_id, count(*) AS total_pairs, max(similarity) AS top_similarity, {COUNTS} FROM job_pairs GROUP BY job_id)
            SELECT j.job_id, user_id, status, coalesce(n_files, 0) AS n_files, first_file, coalesce(p.total_pairs, 0) AS total_pairs, top_similarity,
                   {", ".join(f"coalesce(p.{R.type_column(t)}, 0) AS {R.type_column(t)}" for t in C.CLONE_TYPES)}
            FROM jobs j LEFT JOIN f USING (job_id) LEFT JOIN p USING (job_id)""")

    def survivors(spark, sf):
        left = R.delete_job({"jobs": B.jobs(spark, sf), "files": B.job_files(spark, sf), "pairs": B.job_pairs(spark, sf)}, 7, 7)
        return left["jobs"].select("job_id", F.lit("jobs").alias("t")).unionByName(
            left["files"].select("job_id", F.lit("files").alias("t"))).unionByName(
            left["pairs"].select("job_id", F.lit("pairs").alias("t"))).groupBy("t").agg(F.count("*").alias("n"), F.sum("job_id").alias("ids"))

    doomed = "job_id NOT IN (SELECT job_id FROM jobs WHERE job_id = 7 AND user_id = 7)"
    r.add("delete_job", survivors, f"""WITH {B.SQL_JOBS}, {B.SQL_JOB_FILES}, {B.SQL_JOB_PAIRS},
        u AS (SELECT job_id, 'jobs' AS t FROM jobs UNION ALL SELECT job_id, 'files' FROM job_files UNION ALL SELECT job_id, 'pairs' FROM job_pairs)
        SELECT t, count(*) AS n, CAST(sum(job_id) AS BIGINT) AS ids FROM u WHERE {doomed} GROUP BY t""")

    def survivors_in_place(spark, sf):
        """The same on tables in the shared folder, of which the job's partitions are rewritten."""
        store = JobTables(spark, f"{checkpoint_dir(spark)}/job-tables-{uuid.uuid4().hex}", buckets=16)
        for name, rows in (("jobs", B.jobs(spark, sf)), ("files", B.job_files(spark, sf)), ("pairs", B.job_pairs(spark, sf))):
            store.append(name, rows)
        for job in store.of_job("jobs", 7).select("user_id").collect():
            store.delete_job(7, job.user_id, ["files", "pairs"])
        left = [store.read(name).select("job_id", F.lit(name).alias("t")) for name in ("jobs", "files", "pairs")]
        return left[0].unionAll(left[1]).unionAll(left[2]).groupBy("t").agg(F.count("*").alias("n"), F.sum("job_id").alias("ids"))

    r.add("delete_job_in_place", survivors_in_place, f"""WITH {B.SQL_JOBS}, {B.SQL_JOB_FILES}, {B.SQL_JOB_PAIRS},
        u AS (SELECT job_id, 'jobs' AS t FROM jobs UNION ALL SELECT job_id, 'files' FROM job_files UNION ALL SELECT job_id, 'pairs' FROM job_pairs)
        SELECT t, count(*) AS n, CAST(sum(job_id) AS BIGINT) AS ids FROM u WHERE job_id <> 7 GROUP BY t""")

    ev = "SELECT user_id AS job_id, ts, event_type AS stage, event_id AS n FROM events"
    r.add("latest_progress", lambda spark, sf: R.latest_progress(progress(spark, sf)).select("job_id", "stage", "n"),
          f"SELECT job_id, stage, n FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, stage DESC) AS k FROM ({ev})) WHERE k = 1")

    def positions(spark, sf):
        stage = F.element_at(F.array(*[F.lit(s) for s in (*C.STAGES[1:], "lost")]), (F.col("event_id") % 7 + 1).cast("int"))
        status = F.element_at(F.array(*[F.lit(s) for s in C.JOB_STATUSES]), (F.col("user_id") % 4 + 1).cast("int"))
        p = R.job_position(status, stage)
        return B.table(spark, sf, "events").select("event_id", p["stage"].alias("stage"), p["step"].alias("step"), F.round(p["percent"], 6).alias("percent"))

    stages = "[" + B.quoted((*C.STAGES[1:], "lost")) + "]"
    r.add("job_position", positions, f"""WITH e AS (SELECT event_id, ({stages})[event_id % 7 + 1] AS g, user_id % 4 AS s FROM events),
        v AS (SELECT event_id, CASE s WHEN 2 THEN 'complete' WHEN 0 THEN 'queued' ELSE g END AS stage FROM e),
        k AS (SELECT *, CAST(coalesce(list_position([{B.quoted(C.STAGES)}], stage), 0) - 1 AS INTEGER) AS step FROM v)
        SELECT event_id, stage, step, round(CASE WHEN step < 0 THEN 0.0 ELSE step / 6 * 100 END, 6) AS percent FROM k""")

    r.add("pct", lambda spark, sf: B.scored(spark, sf).select("doc_id", N.pct("score").alias("percent")),
          f"WITH {B.SQL_SCORED} SELECT doc_id, CAST(floor(score * 100 + 0.5) AS INTEGER) AS percent FROM scored")

    from twinspan.streaming.progress import current_state, job_state, stream_job_state

    states = f"SELECT job_id, arg_max(stage, (ts, stage)) AS stage, count(*) AS events FROM ({ev}) GROUP BY job_id"
    r.add("job_state", lambda spark, sf: job_state(progress(spark, sf)).select("job_id", "stage", "events"), states)

    def streamed(spark, sf):
        given = B.table(spark, sf, "events")
        stream = spark.readStream.schema(given.schema).parquet(f"{sf}/events.parquet*")
        at = f"{checkpoint_dir(spark)}/job-state-{uuid.uuid4().hex}"
        stream_job_state(as_progress(stream), f"{at}/out", f"{at}/state").awaitTermination()
        return current_state(spark.read.parquet(f"{at}/out")).select("job_id", "stage", "events")

    r.add("stream_job_state", streamed, states)
