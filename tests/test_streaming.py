"""Streams give what one batch gives."""

import re

from pyspark.sql import functions as F

from twinspan.operators import copies as K
from twinspan.operators import near_miss as M
from twinspan.streaming import intake, progress

BODY = "int sum(int n) { int s = 0; for (int i = 0; i < n; i++) { s += i * 2; } return s; }"
TEXTS = [BODY, BODY.replace("s", "t"), BODY, BODY.replace("* 2", "* 3 + 1"), BODY.replace("i * 2", "i * 2 - n"), "float other(float q) { return q / 4 - 9; }", BODY]
SCHEMA = "job_id STRING, file STRING, file_ord INT, language STRING, content STRING"


def test_intake_equals_batch(spark, tmp_path):
    rows = [("j", f"{i}.c", i, "c", t) for i, t in enumerate(TEXTS)]
    src = str(tmp_path / "in")
    order = [3, 0, 6, 1, 5, 2, 4]
    for at in order:
        spark.createDataFrame([rows[at]], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(src)
    q = intake.stream_detect(stream, str(tmp_path / "corpus"), str(tmp_path / "links"), str(tmp_path / "ck"))
    q.awaitTermination()
    frags = intake.fingerprint_batch(spark.createDataFrame(rows, SCHEMA))
    want = {(r.clone_type, r.frag_id_a, r.frag_id_b) for r in K.copy_links(frags).collect()}
    got = intake.current_copies(spark.read.parquet(str(tmp_path / "links/copies"))).collect()
    assert {(r.clone_type, r.frag_id_a, r.frag_id_b) for r in got} == want and len(want) == 3
    listed = lambda df: sorted((r.near_fp_a, r.near_fp_b, round(r.similarity, 9), r.n_pairs, r.rep_a, r.rep_b) for r in df.collect())
    near = listed(M.near_miss_join(frags))
    assert listed(intake.current_near_misses(spark.read.parquet(str(tmp_path / "links/near")))) == near and near


def test_windows_of_one_file_that_share_lines_are_no_near_miss(spark, tmp_path):
    """140 lines give the windows 1-80 and 61-140; an empty first batch fixes no element order."""
    long = "\n".join(["total = total + value * 2;"] * 9 + ["if (total > 5) { total = 0; }"] + ["total = total + value * 2;"] * 130)
    src = str(tmp_path / "in")
    for row in (("j", "empty.c", 0, "c", ""), ("j", "long.c", 1, "c", long), ("j", "again.c", 2, "c", long.replace("total", "sum"))):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    intake.stream_detect(stream, str(tmp_path / "corpus"), str(tmp_path / "links"), str(tmp_path / "ck")).awaitTermination()
    frags = intake.fingerprint_batch(spark.read.schema(SCHEMA).parquet(src))
    listed = lambda df: sorted((r.near_fp_a, r.near_fp_b, r.n_pairs) for r in df.collect())
    want = listed(M.near_miss_join(frags))
    assert listed(intake.current_near_misses(spark.read.parquet(str(tmp_path / "links/near")))) == want
    # Each window meets the other file's other window, in either direction.
    assert [n for *_, n in want] == [2]


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    """Files of many scopes and weights are filed apart; a small batch opens few of them."""
    corpus = intake.Corpus(spark, str(tmp_path / "corpus"), 0.75)
    many = [(f"j{i}", f"{i}.c", i, "c", BODY.replace("i * 2", " + ".join(["i * 2"] * (1 + i % 40)))) for i in range(120)]
    corpus.append(spark.createDataFrame(many, SCHEMA), 0, False)
    frags, touched = corpus.append(spark.createDataFrame([("j7", "new.c", 500, "c", BODY)], SCHEMA), 1, False)
    opened, near = corpus.shapes(1, touched, 3), corpus.frags(1, frags)
    for table, found, column in (("shapes", opened, "partition"), ("frags", near, "bucket")):
        files = found.select(F.input_file_name()).distinct().count()
        assert 0 < files < len(spark.read.parquet(f"{corpus.path}/{table}").inputFiles()) / 4
        plan = found._jdf.queryExecution().toString()
        assert re.search(rf"PartitionFilters: \[[^\]]*{column}#", plan)
    # Nothing that could be a partner is left out.
    whole = spark.read.parquet(f"{corpus.path}/shapes").filter("job_id = 'j7'").select("param_fp")
    assert {r[0] for r in whole.collect()} == {r[0] for r in opened.filter("job_id = 'j7'").select("param_fp").collect()}


def test_a_batch_of_one_row_group_is_cut_by_many_tasks(spark, tmp_path, monkeypatch):
    corpus = intake.Corpus(spark, str(tmp_path / "corpus"), 0.75)
    rows = [("j", f"{i}.c", i, "c", BODY + "\n" * (i % 9) + f"int x = {' + '.join(['1'] * i)};") for i in range(1, 200)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    cut, seen = intake.fingerprint_batch, []
    monkeypatch.setattr(intake, "fingerprint_batch", lambda files, lexer: seen.append(files.select(F.spark_partition_id()).distinct().count()) or cut(files, lexer))
    stored = corpus.store(spark.read.parquet(str(tmp_path / "in")), 0, False)
    assert seen[0] > 1 and stored.count() == 199
    # One file a bucket, not one for each bucket and task.
    folders = [f.rsplit("/", 1)[0] for f in stored.inputFiles()]
    assert len(folders) == len(set(folders)) > 1


def test_registered_streams_equal_one_run(spark):
    from tests.conftest import SMALL
    from twinspan.catalog import registry

    queries = registry.build().queries
    listed = lambda name: sorted(map(tuple, queries[name](spark, SMALL).collect()))
    assert listed("stream_detect") == listed("near_miss_join")


def test_job_state_equals_batch(spark, tmp_path):
    schema = "job_id INT, ts TIMESTAMP, stage STRING"
    src = str(tmp_path / "ev")
    for k in range(3):
        df = spark.range(20).select(
            (F.col("id") % 4).cast("int").alias("job_id"),
            (F.timestamp_seconds(F.col("id") * 7 % 20 + 100 * ((k + 1) % 3))).alias("ts"),
            F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("stage"))
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = progress.stream_job_state(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = progress.current_state(spark.read.parquet(str(tmp_path / "out")))
    want = progress.job_state(spark.read.schema(schema).parquet(src))
    key = lambda d: sorted((r.job_id, r.stage, r.ts, r.events) for r in d.collect())
    assert key(got) == key(want)


def test_finished_jobs_leave_the_state(spark, tmp_path):
    """Three runs of one query: a finished job expires, a late event and a null time still count."""
    import datetime
    import time

    schema = "job_id INT, ts TIMESTAMP, stage STRING"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    src, ck, out = (str(tmp_path / n) for n in ("ev", "ck", "out"))
    batches = [
        [(1, at(5), "complete"), (1, at(2), "queued"), (2, at(1), "semantic"), (None, at(1), "queued"), (3, None, "queued")],
        [(2, at(9), "preparing"), (2, at(9), "extracting")],
        [(1, at(3), "semantic"), (3, None, None), (4, at(4), "failed")],
    ]
    held = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = progress.stream_job_state(stream, out, ck, keep_seconds=0.001, idle_seconds=1000)
        assert q.awaitTermination(60)
        held.append(q.recentProgress)
        time.sleep(0.1)
    got = progress.current_state(spark.read.parquet(out))
    want = progress.job_state(spark.read.schema(schema).parquet(src))
    key = lambda d: sorted((str(r.job_id), r.stage, r.ts, r.events) for r in d.collect())
    assert key(got) == key(want)
    # Jobs 2, 3 and the one without a number stay; job 1 has left and come back as a second life.
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in (r for run in held for r in run) if p["stateOperators"]]
    assert 3 in rows
    lives = {r.job_id: r.n for r in spark.read.parquet(out).groupBy("job_id").agg(F.countDistinct("life").alias("n")).collect()}
    assert lives == {1: 2, 2: 1, 3: 1, 4: 1, None: 1}
