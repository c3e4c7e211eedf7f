"""Folder scan, sinks, caching and small expressions."""

import pytest
from pyspark.sql import functions as F

from twinspan.functions import text as X
from twinspan.operators import rollups as R
from twinspan.operators import segment as G
from twinspan.sources import embeddings as cache
from twinspan.sources import sinks, tables
from twinspan.sources.tree import scan_source_tree


@pytest.fixture
def tree(tmp_path):
    for name in ("a.py", "pkg/__init__.py", ".hidden/b.java", "build/c.C", "notes.txt", "noext"):
        f = tmp_path / "src" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x = 1\r\ny = \xff\n")
    return str(tmp_path / "src")


def test_scan_finds_hidden_and_underscore_files(spark, tree):
    rows = scan_source_tree(spark, tree).orderBy("file_ord").collect()
    assert [r.file for r in rows] == ["a.py", ".hidden/b.java", "build/c.C", "pkg/__init__.py"]
    assert rows[0].content == "x = 1\ny = \ufffd\n"
    assert {r.language for r in rows} == {"python", "java", "c"}


def test_scan_options(spark, tree):
    assert scan_source_tree(spark, tree, exclude=["build", ".hidden"]).count() == 2
    assert scan_source_tree(spark, tree, slice_bytes=1).count() == 4
    with pytest.raises(Exception, match="more than 2 code files"):
        scan_source_tree(spark, tree, max_files=2).count()
    with pytest.raises(Exception, match="size limit"):
        scan_source_tree(spark, tree, max_mb=0.000001).count()


def test_scan_of_deep_and_empty_folders(spark, tmp_path):
    """Every level is listed by tasks; links to folders are not followed, empty folders give nothing."""
    from twinspan.sources import tree as scan

    root = tmp_path / "src"
    deep = root.joinpath(*"abcdef")
    deep.mkdir(parents=True)
    (root / "empty").mkdir()
    (deep / "z.py").write_bytes(b"")
    (deep / "\u00e9.py").write_bytes(b"x")
    (root / "a" / "many").mkdir()
    for i in range(25):
        (root / "a" / "many" / f"{i}.c").write_bytes(b"y" * i)
    (root / "loop").symlink_to(root)
    rows = scan_source_tree(spark, str(root), slice_bytes=100).collect()
    assert len(rows) == 27 and {r.file for r in rows} >= {"a/b/c/d/e/f/z.py", "a/b/c/d/e/f/\u00e9.py"}
    assert {len(r.content) for r in rows if r.file.startswith("a/many/")} == set(range(25))
    listed = scan.code_files(spark, str(root), frozenset(["py", "c"]), []).collect()
    assert sorted((r.path, r.size) for r in listed) == sorted((r.file, len(r.content)) for r in rows)
    assert scan_source_tree(spark, str(root / "empty")).count() == 0
    with pytest.raises(ValueError, match="not a directory"):
        scan_source_tree(spark, str(root / "none"))


def test_split_lines_follows_all_breaks(spark):
    df = spark.createDataFrame([("a\r\nb\rc\u2028d\n\ne\n",), ("",), ("\n",)], "t STRING")
    got = [r.v for r in df.select(X.split_lines("t").alias("v")).collect()]
    assert got == ["a\r\nb\rc\u2028d\n\ne\n".splitlines(), [], [""]]


def test_tokens_keep_non_ascii_names_whole(spark):
    df = spark.createDataFrame([('café = "a\\"b" /* c */ + 1.5 // x\n<<= é55',)], "t STRING")
    assert df.select(X.tokens("t").alias("v")).first().v == ["café", "=", '"a\\"b"', "+", "1.5", "<<=", "é", "5", "5"]


def test_strip_comments_keeps_strings(spark):
    df = spark.createDataFrame([("a /* x\ny */ b\n// gone\nc = '//' + \"/*\"; // t\n",)], "t STRING")
    assert df.select(X.strip_comments("t").alias("v")).first().v == "a   b\nc = '//' + \"/*\";  "


def test_brace_blocks(sources):
    code = "int f(int a)\n{\n  // }\n  char *s = \"}\";\n  if (a) { return 1; }\n  return 0;\n}\nstatic void g(void) { x(); }\nint p(void);\n"
    files = sources(("a.c", code))
    masked = files.withColumn("content", G.mask_code("content"))
    got = sorted((r.start_line, r.end_line, r.name) for r in G.brace_blocks(G.split_lines(masked)).collect())
    assert got == [(1, 7, "f"), (8, 8, "g")]


def test_decorators_and_nested_heads(sources):
    code = "@dec\ndef f(a):\n    x = a\n\n    def g():\n        return 1\n    return x\n\nprint(1)\nasync def h(\n    b,\n):\n    pass\n"
    got = sorted((r.start_line, r.end_line, r.name) for r in G.indent_blocks(G.split_lines(sources(("a.py", code)))).collect())
    assert got == [(1, 7, "f"), (5, 6, "g"), (10, 13, "h")]


def test_duplicate_paths_and_sizes(spark, sources):
    files = sources(("/a.py", "x"), ("a.py", "yy"))
    assert tables.duplicate_paths(files).first().n == 2
    assert tables.first_of_each_path(files).first().content == "x"
    assert tables.check_file_size(files, 1.5 / 1024 / 1024, "drop").count() == 1
    with pytest.raises(Exception, match="MB limit"):
        tables.check_file_size(files, 1.5 / 1024 / 1024).count()


def test_embedding_cache(spark):
    frags = spark.createDataFrame([("a", "c"), ("a", "c"), ("b", "c"), ("x", "c")], "code STRING, language STRING")
    old = spark.createDataFrame([("b", [1.0, 0.0], 5), ("x", [1.0], 5), ("a", [0.0, 1.0], 500)], "code STRING, vector ARRAY<DOUBLE>, age INT")
    store = old.select(cache.code_key().alias("key"), "vector", (F.current_timestamp() - F.make_interval(secs=F.col("age"))).alias("stored_at"))
    calls = []

    def provider(rows):
        calls.append(sorted(r.code for r in rows.collect()))
        return rows.select("key", F.array(F.lit(0.5), F.lit(0.5)).alias("vector"))

    out, fresh = cache.embed_with_cache(frags, store, provider, 2, ttl_seconds=100)
    assert out.count() == 4 and fresh.count() == 2
    assert calls == [["a", "x"]]
    with pytest.raises(Exception, match="invalid vector"):
        cache.embed_with_cache(frags, store, lambda r: r.select("key", F.array(F.lit(0.0), F.lit(0.0)).alias("vector")), 2)[0].collect()


def test_bucketed_cache_is_never_shuffled(spark, tmp_path):
    store = cache.EmbeddingCache(spark, str(tmp_path / "cache"), buckets=8)
    frags = spark.createDataFrame([("a", "c"), ("a", "c"), ("b", "c"), ("x", "c")], "code STRING, language STRING")
    seen = []

    def provider(rows):
        seen.append(sorted(r.code for r in rows.collect()))
        return rows.select("key", F.array(F.lit(0.5), F.lit(0.25)).alias("vector"))

    assert store.embed(frags, provider, 2).count() == 4
    more = spark.createDataFrame([("b", "c"), ("n", "c")], "code STRING, language STRING")
    assert store.embed(more, provider, 2).count() == 2
    assert seen == [["a", "b", "x"], ["n"]]
    old = spark.createDataFrame([("a",), ("gone",)], "code STRING").select(
        cache.code_key().alias("key"), F.array(F.lit(9.0), F.lit(9.0)).alias("vector"), F.expr("current_timestamp() - INTERVAL 9 HOURS").alias("stored_at"))
    store.append(old)
    # The newest row of a repeated key counts, and each fragment comes once.
    assert {tuple(r.vector) for r in store.embed(frags, provider, 2).collect()} == {(0.5, 0.25)} and seen[-1] == []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cache.look_up(frags, cache.valid_cache(store.read(), 2), store.buckets)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = next(k for k, line in enumerate(plan.splitlines()) if "embedding_cache_data" in line)
    join = next(k for k, line in enumerate(plan.splitlines()) if "SortMergeJoin" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    above = [line for k, line in enumerate(lines[join:scan], join) if "Exchange" in line and depth(line) < depth(lines[scan])
             and not any(depth(other) <= depth(line) for other in lines[k + 1 : scan + 1])]
    assert above == [] and "Exchange hashpartitioning(key" in plan
    for _ in range(2):
        store.compact(2, ttl_seconds=3600)
    assert store.read().count() == 4 and store.embed(frags, provider, 2).count() == 4 and seen[-1] == []
    # Another session's view of the folder: the number of buckets is the folder's.
    assert cache.EmbeddingCache(spark, store.folder, buckets=3).buckets == 8


def pairs(spark):
    row = ("j", "Type-1", 1.0, "d,ir/a.c", "b.c", "c", "c", 1, 4, 2, 5, False)
    cols = "job_id STRING, clone_type STRING, similarity DOUBLE, file_a STRING, file_b STRING, language_a STRING, language_b STRING, start_line_a INT, end_line_a INT, start_line_b INT, end_line_b INT, cross_language BOOLEAN"
    return spark.createDataFrame([row, ("j", "Type-3", 0.8, "b.c", "b.c", "c", "c", 1, 2, 7, 8, False)], cols)


def test_sinks_round_trip(spark, tmp_path):
    p = pairs(spark)
    sinks.write_clone_pairs(p, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).filter("job_id = 'j'").count() == 2
    sinks.export_csv(p, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("type").first()
    assert (back.file_a, back.lines_a, back.type) == ("d,ir/a.c", "1-4", "Type-1")
    sinks.export_json(p, str(tmp_path / "json"))
    sinks.write_run({"pairs": p}, str(tmp_path / "run"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_run({"pairs": p}, str(tmp_path / "run"))


def test_clone_pairs_of_a_job_are_replaced(spark, tmp_path):
    p, path = pairs(spark), str(tmp_path / "pairs")
    sinks.write_clone_pairs(p.unionByName(p.withColumn("job_id", F.lit("other"))), path)
    for _ in range(2):
        sinks.write_clone_pairs(p.filter("clone_type = 'Type-3'"), path, "replace")
        left = spark.read.parquet(path).groupBy("job_id").count().orderBy("job_id").collect()
        assert [tuple(r) for r in left] == [("j", 1), ("other", 2)]


def test_a_run_is_written_whole_or_not_at_all(spark, tmp_path):
    """The third table fails: no run, nothing left; the retry succeeds and keeps types."""
    folder = str(tmp_path / "run")
    good = spark.range(3).select("id", F.current_date().alias("day"), F.lit(None).cast("decimal(9,2)").alias("share"))
    bad = spark.range(2).select(F.raise_error(F.lit("broken table")).alias("x"))
    with pytest.raises(Exception, match="broken table"):
        sinks.write_run({"a": good, "b": good, "c": bad}, folder)
    with pytest.raises(FileNotFoundError):
        sinks.read_run(spark, folder)
    assert [f for f in (tmp_path / "run").rglob("*") if f.is_file()] == []
    sinks.write_run({"a": good, "b": good.limit(0)}, folder)
    back = sinks.read_run(spark, folder)
    assert back["a"].dtypes == good.dtypes and back["a"].orderBy("id").collect() == good.collect()
    assert back["b"].dtypes == good.dtypes and back["b"].count() == 0
    with pytest.raises(FileExistsError):
        sinks.write_run({"a": good}, folder)


def test_same_file_pair_counts_once(spark):
    p = pairs(spark)
    assert {r.file: r.clone_count for r in R.files_with_clones(p).collect()} == {"d,ir/a.c": 1, "b.c": 2}
    assert {r.file: r.n_messages for r in R.diagnostics_by_file(p).collect()} == {"d,ir/a.c": 1, "b.c": 3}
    assert R.filter_pairs(p, file="\\b.c").count() == 2


def test_delete_job_respects_the_owner(spark):
    jobs = spark.createDataFrame([(1, 10), (2, 20)], "job_id INT, user_id INT")
    files = spark.createDataFrame([(1, "a"), (2, "b")], "job_id INT, file STRING")
    mine = R.delete_job({"jobs": jobs, "files": files}, 1, 10)
    assert mine["jobs"].count() == 1 and mine["files"].first().file == "b"
    other = R.delete_job({"jobs": jobs, "files": files}, 1, 20)
    assert other["jobs"].count() == 2 and other["files"].count() == 2


def test_deleting_a_job_rewrites_its_partitions_only(spark, tmp_path):
    from twinspan.operators.store import staged
    from twinspan.sources.job_tables import JobTables

    store = JobTables(spark, str(tmp_path / "jobs"), buckets=4)
    assert JobTables(spark, store.folder, buckets=99).buckets == 4
    jobs = spark.range(40).select(F.col("id").alias("job_id"), (F.col("id") % 3).alias("user_id"))
    files = jobs.select("job_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).unionByName(
        spark.createDataFrame([(None, 9)], "job_id LONG, n INT"))
    store.append("jobs", jobs)
    store.append("files", files)
    listed = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "jobs").rglob("part-*.parquet")}
    before, kept = listed(), staged()
    assert not store.delete_job(7, 0, ["files"]) and not store.delete_job(70, 1, ["files"]) and listed() == before
    assert store.delete_job(7, 1, ["files"])
    mine = f"job_bucket={store._bucket_of(7)}"
    assert {f: t for f, t in listed().items() if mine not in str(f)} == {f: t for f, t in before.items() if mine not in str(f)}
    after = listed()
    assert not store.delete_job(7, 1, ["files"]) and listed() == after and staged() == kept
    assert {r.job_id for r in store.read("jobs").collect()} == set(range(40)) - {7}
    assert store.read("files").filter("job_id = 7").count() == 0 and store.read("files").count() == 40 * 3 + 1 - 3
    assert store.of_job("files", 8).count() == 3
    # A bucket that loses its last job leaves no file behind.
    alone = [j for j in range(40) if j != 7 and store._bucket_of(j) == store._bucket_of(7)]
    for j in alone:
        assert store.delete_job(j, j % 3, ["files"])
    assert not [f for f in listed() if mine in str(f) and "/jobs/jobs/" in str(f)]


def test_staged_tables_are_released(spark):
    from twinspan.operators.store import release, stage, staged

    before = staged()
    df, kept = stage(spark.range(10), "ten"), stage(spark.range(5), "five")
    own = [t for t in staged() if t not in before]
    assert df.count() == 10 and len(own) == 2
    assert release(spark, own, keep=kept) == 1 and kept.count() == 5
    with pytest.raises(Exception, match="(?i)not exist|not_exist|not found"):
        df.count()
