"""Bindings from the given tables to operator inputs, in Spark and in SQL.

The SQL side is written independently for DuckDB and shares only fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.operators import copies, segment
from twinspan.sources.tables import from_table, read_spread

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/{name}.parquet")


def pair_up(df: DataFrame, key: str, *carry: str) -> DataFrame:
    """Pair every row with the one whose integer ``key`` is one more."""
    side = lambda s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in (key, *carry)])
    return side("a").withColumn("_next", F.col(f"{key}_a") + 1).join(
        side("b").withColumn("_next", F.col(f"{key}_b")), "_next").drop("_next")


def counts(df: DataFrame, *cols: str) -> DataFrame:
    """Exact totals as LONG, which they fit in the given tables."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# --- documents as source files ------------------------------------------------

def file_name():
    return F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def files(spark: SparkSession, sf_dir: str, by_source: bool = False) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    return from_table(docs, file_name(), "text", "lang", "doc_id", "source" if by_source else None)


def tokenised(spark: SparkSession, sf_dir: str, by_source: bool = False) -> DataFrame:
    return segment.with_tokens(segment.fragments(files(spark, sf_dir, by_source)), python_lexer=False)


def prints(spark: SparkSession, sf_dir: str, by_source: bool = False) -> DataFrame:
    return copies.fingerprints(segment.usable_fragments(tokenised(spark, sf_dir, by_source)))


def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clone-pair table of neighbouring documents with types and scores from their sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    p = pair_up(docs, "doc_id", "source", "lang", "n_chars")
    name = lambda s: F.concat(f"source_{s}", F.lit("/"), F.col(f"doc_id_{s}").cast("string"), F.lit(".txt"))
    small, large = F.least("n_chars_a", "n_chars_b"), F.greatest("n_chars_a", "n_chars_b")
    return p.select(
        F.col("source_a").alias("job_id"),
        name("a").alias("file_a"), name("b").alias("file_b"),
        F.col("lang_a").alias("language_a"), F.col("lang_b").alias("language_b"),
        F.lit(1).alias("start_line_a"), (1 + F.col("n_chars_a") % 80).cast("int").alias("end_line_a"),
        F.lit(1).alias("start_line_b"), (1 + F.col("n_chars_b") % 80).cast("int").alias("end_line_b"),
        F.concat(F.lit("Type-"), (1 + (F.col("n_chars_a") + F.col("n_chars_b")) % 4).cast("string")).alias("clone_type"),
        (F.floor(small / large * 10000) / 10000).alias("similarity"),
        (F.col("lang_a") != F.col("lang_b")).alias("cross_language"),
        F.col("doc_id_a").alias("id_a"), F.col("doc_id_b").alias("id_b"),
        (F.col("n_chars_a") + F.col("n_chars_b")).alias("n_sum"),
    )


SQL_FILE_PAIRS = """
dp AS (
  SELECT a.doc_id AS id_a, a.source AS source_a, a.lang AS lang_a, a.n_chars AS n_a,
         b.doc_id AS id_b, b.source AS source_b, b.lang AS lang_b, b.n_chars AS n_b
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
pairs AS (
  SELECT source_a AS job_id, source_a || '/' || id_a || '.txt' AS file_a,
         source_b || '/' || id_b || '.txt' AS file_b, lang_a AS language_a, lang_b AS language_b,
         1 AS start_line_a, 1 + n_a % 80 AS end_line_a, 1 AS start_line_b, 1 + n_b % 80 AS end_line_b,
         'Type-' || (1 + (n_a + n_b) % 4) AS clone_type,
         floor(least(n_a, n_b) / greatest(n_a, n_b) * 10000) / 10000 AS similarity,
         lang_a <> lang_b AS cross_language, id_a, id_b, n_a + n_b AS n_sum
  FROM dp)
"""


def sql_fragments(job: str = "'all'") -> str:
    return f"""
raw AS (
  SELECT {job} AS job_id, source || '/' || doc_id || '.txt' AS file, doc_id AS file_ord, lang AS language,
         string_split(text, chr(10)) AS l0 FROM documents),
cut1 AS (SELECT * EXCLUDE l0, CASE WHEN l0[-1] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS l1 FROM raw),
cut2 AS (SELECT * EXCLUDE l1, CASE WHEN l1[-1] = '' THEN l1[1:len(l1) - 1] ELSE l1 END AS l FROM cut1),
offs AS (
  SELECT *, unnest(range(0, CAST(ceil(greatest(len(l) - 80, 0) / 60.0) * 60 AS BIGINT) + 1, 60)) AS o
  FROM cut2 WHERE len(list_filter(l, lambda x: regexp_matches(x, '\\S'))) > 0),
frag AS (
  SELECT job_id, file, file_ord, language, o + 1 AS start_line, least(o + 80, len(l)) AS end_line,
         file || '#' || (o + 1) || '#' || least(o + 80, len(l)) AS frag_id,
         array_to_string(l[o + 1:o + 80], chr(10)) AS code FROM offs)
"""


def sql_tokens(job: str = "'all'") -> str:
    return sql_fragments(job) + f""",
tok AS (
  SELECT *, list_filter(regexp_extract_all(code, {pattern(C.TOKEN_PATTERN_PLAIN)}),
                        lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*')) AS tokens FROM frag),
usable AS (
  SELECT * FROM tok WHERE len(tokens) >= 3
    AND len(list_filter(tokens, lambda t: regexp_matches(t, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*$'))) > 0
    AND NOT (tokens[-1] IN ('{{', ':') AND list_has_any(tokens, ['class', 'interface', 'enum'])))
"""


def sql_params(job: str = "'all'") -> str:
    keywords = quoted(C.KEYWORDS)
    return sql_tokens(job) + f""",
each AS (SELECT frag_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM usable),
kinds AS (
  SELECT *, CASE WHEN t IN ({keywords}) THEN 0
                 WHEN regexp_matches(t, '^[\\p{{Nd}}"'']') THEN 2
                 WHEN regexp_matches(t, '^[\\p{{L}}_$][\\p{{L}}\\p{{N}}_$]*$') THEN 1 ELSE 0 END AS kind FROM each),
names AS (
  SELECT frag_id, t, row_number() OVER (PARTITION BY frag_id ORDER BY min(pos)) - 1 AS k
  FROM kinds WHERE kind = 1 GROUP BY frag_id, t),
renamed AS (
  SELECT k.frag_id, k.pos, k.t, CASE kind WHEN 1 THEN 'ID_' || n.k WHEN 2 THEN 'LITERAL' ELSE k.t END AS p
  FROM kinds k LEFT JOIN names n ON k.kind = 1 AND n.frag_id = k.frag_id AND n.t = k.t),
par AS (
  SELECT frag_id, list(p ORDER BY pos) AS params,
         list(CASE WHEN p = 'LITERAL' THEN t ELSE p END ORDER BY pos) AS near
  FROM renamed GROUP BY frag_id),
prints AS (SELECT u.*, params, near FROM usable u JOIN par USING (frag_id))
"""


# --- orders as jobs ------------------------------------------------------------


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"), status.alias("status"),
        (F.col("o_orderkey") % 7).alias("total_pairs"), (F.col("o_orderkey") % 50).alias("total_fragments"),
        *[(F.col("o_orderkey") % (7 + i) % 3).alias(f"type{i}_count") for i in (1, 2, 3, 4)])


SQL_JOBS = """
jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderdate AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
         o_orderkey % 7 AS total_pairs, o_orderkey % 50 AS total_fragments,
         o_orderkey % 8 % 3 AS type1_count, o_orderkey % 9 % 3 AS type2_count,
         o_orderkey % 10 % 3 AS type3_count, o_orderkey % 11 % 3 AS type4_count FROM orders)
"""


def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("job_id"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), F.lit(".c")).alias("file"))


SQL_JOB_FILES = """
job_files AS (SELECT l_orderkey AS job_id, 'part' || l_partkey || '/' || l_linenumber || '.c' AS file FROM lineitem)
"""


def job_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("job_id"),
        F.concat(F.lit("Type-"), (1 + F.col("l_partkey") % 4).cast("string")).alias("clone_type"),
        F.col("l_quantity").alias("similarity"))


SQL_JOB_PAIRS = """
job_pairs AS (SELECT l_orderkey AS job_id, 'Type-' || (1 + l_partkey % 4) AS clone_type, l_quantity AS similarity FROM lineitem)
"""


# --- labelled pairs and scores --------------------------------------------------


def labeled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring labelled documents; label 1 when of the same quality."""
    lab = table(spark, sf_dir, "labels")
    p = pair_up(lab, "doc_id", "quality")
    r = F.pmod(F.col("doc_id_a"), F.lit(10))
    return p.select(
        F.when(r < 6, "train").when(r < 8, "valid").otherwise("test").alias("split"),
        F.col("doc_id_a").alias("a_id"), F.col("doc_id_b").alias("b_id"),
        (F.col("quality_a") == F.col("quality_b")).cast("int").alias("label"), F.col("doc_id_a").alias("ordinal"))


SQL_LABELED = """
lp AS (
  SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.quality AS qa, b.quality AS qb
  FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1),
lpairs AS (
  SELECT CASE WHEN a_id % 10 < 6 THEN 'train' WHEN a_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split,
         a_id, b_id, CASE WHEN qa = qb THEN 1 ELSE 0 END AS label, a_id AS ordinal
  FROM lp)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label and a score from their length, rich in ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    s = F.floor(F.col("n_chars") / (F.col("n_chars") + 1500) * 100) / 100
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("label"), s.alias("score"))


SQL_SCORED = """
scored AS (
  SELECT doc_id, lang, quality AS label, floor(n_chars / (n_chars + 1500) * 100) / 100 AS score
  FROM documents JOIN labels USING (doc_id))
"""
