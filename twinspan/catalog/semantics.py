"""Cosine joins, evidence, decisions and hashed features."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.catalog import common as B
from twinspan.functions import numeric as N
from twinspan.operators import segment
from twinspan.operators import semantic as S
from twinspan.operators.vector_tree import cosine_join
from twinspan.plans.semantic import detect_all
from twinspan.sources.tables import from_table

TAU = 0.35

# --- documents as code of two languages, with vectors and outcomes ---------------

SQL_LANGUAGE = "CASE WHEN lang IN ('en', 'de') THEN 'java' ELSE 'python' END AS language"


def four_types(spark, sf, threshold):
    """Documents with the first four components of the vector of the same number; equal labels behave alike."""
    docs = B.spread_table(spark, sf, "documents")
    language = F.when(F.col("lang").isin("en", "de"), "java").otherwise("python")
    files = from_table(docs, B.file_name(), "text", language, "doc_id", "source")
    options = {"python_lexer": False}
    # A fragment is named by its place, so its file's vector is found by the file.
    frags = segment.with_tokens(segment.fragments(files), python_lexer=False).select("job_id", "frag_id", "file_ord")
    known = frags.join(B.table(spark, sf, "embeddings"), F.col("vec_id") == F.col("file_ord"))
    vectors = known.select("job_id", "frag_id", F.slice("embedding", 1, 4).alias("vector"))
    outcomes = known.select(
        "job_id", "frag_id", "label", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("sample_idx")).select(
        "job_id", "frag_id", F.lit(1).alias("arity"), "sample_idx", F.lit("int").alias("out_type"),
        (F.col("sample_idx") * (F.col("label") + 1) % 5).cast("string").alias("out_repr"), F.lit("").alias("args_repr"))
    found = detect_all(files, vectors, outcomes, threshold, 4, C.DEFAULT_THRESHOLD, **options)
    return found.select("job_id", "language", "clone_type", "similarity", "frag_id_a", "frag_id_b", "cross_language")


SQL_FOUR_TYPES = f"""WITH {B.sql_params("source").replace("lang AS language", SQL_LANGUAGE)},
  e AS (SELECT job_id, language, params, tokens, arg_min(frag_id, (file_ord, start_line, end_line)) AS hub,
               min((file_ord, start_line, end_line)) AS o FROM prints GROUP BY job_id, language, params, tokens),
  q AS (SELECT job_id, language, params, arg_min(hub, o) AS top FROM e GROUP BY job_id, language, params),
  v AS (SELECT p.*, embedding[1:4]::DOUBLE[] AS v, label FROM prints p JOIN embeddings ON vec_id = file_ord)
  SELECT job_id, language, 'Type-1' AS clone_type, 1.0::DOUBLE AS similarity, hub AS frag_id_a, p.frag_id AS frag_id_b, false AS cross_language
  FROM prints p JOIN e USING (job_id, language, params, tokens) WHERE p.frag_id <> hub
  UNION ALL SELECT job_id, language, 'Type-2', 1.0, top, hub, false FROM e JOIN q USING (job_id, language, params) WHERE top <> hub
  UNION ALL SELECT a.job_id, CASE WHEN a.language = b.language THEN a.language ELSE 'java:python' END, 'Type-4',
         round(list_cosine_similarity(a.v, b.v), 6), a.frag_id, b.frag_id, a.language <> b.language
  FROM v a JOIN v b ON a.job_id = b.job_id AND (a.file_ord, a.start_line, a.end_line) < (b.file_ord, b.start_line, b.end_line)
   AND (a.file <> b.file OR a.end_line < b.start_line OR b.end_line < a.start_line)
   AND NOT (a.language = b.language AND a.params = b.params) AND list_cosine_similarity(a.v, b.v) >= 0.7
   AND a.label % 5 = b.label % 5 AND (a.label + 1) % 5 <> 0"""


def vector_pairs(spark, sf):
    return B.pair_up(B.table(spark, sf, "embeddings").select("vec_id"), "vec_id").select(
        F.col("vec_id_a").alias("a_id"), F.col("vec_id_b").alias("b_id"))


SQL_VECTOR_PAIRS = """
vpairs AS (SELECT x.vec_id AS a_id, y.vec_id AS b_id FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
"""


def embeddings(spark, sf):
    return B.spread_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def outcomes(spark, sf):
    """Line items as probe outcomes: one per order and line number."""
    li = B.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.struct("l_returnflag", F.floor(F.col("l_quantity") / 25).cast("int").cast("string").alias("q"), "l_linestatus")).alias("o"))
    return li.select(
        F.col("l_orderkey").alias("frag_id"), (F.col("l_orderkey") % 40 < 38).cast("int").alias("arity"),
        F.col("l_linenumber").alias("sample_idx"), F.lit("int").alias("out_type"),
        F.col("o.q").alias("out_repr"), F.lit("").alias("args_repr"))


SQL_OUTCOMES = """
oc AS (SELECT l_orderkey AS frag_id, CASE WHEN l_orderkey % 40 < 38 THEN 1 ELSE 0 END AS arity, l_linenumber AS sample_idx,
              CAST(CAST(floor(min((l_returnflag, CAST(CAST(floor(l_quantity / 25) AS INTEGER) AS VARCHAR), l_linestatus))[2]::DOUBLE) AS INTEGER) AS VARCHAR) AS out_repr
       FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""


def order_pairs(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    p = B.pair_up(o, "o_orderkey", "o_totalprice", "o_orderstatus")
    lang = lambda s: F.when(F.col(f"o_orderstatus_{s}") == "F", "java").when(F.col(f"o_orderstatus_{s}") == "O", "python").otherwise("c")
    ratio = F.least("o_totalprice_a", "o_totalprice_b") / F.greatest("o_totalprice_a", "o_totalprice_b")
    return p.select(
        F.col("o_orderkey_a").alias("a_id"), F.col("o_orderkey_b").alias("b_id"),
        lang("a").alias("language_a"), lang("b").alias("language_b"), (F.floor(ratio * 100) / 100).alias("score"))


SQL_ORDER_PAIRS = """
op0 AS (SELECT x.o_orderkey AS a_id, y.o_orderkey AS b_id, x.o_totalprice AS pa, y.o_totalprice AS pb,
               x.o_orderstatus AS sa, y.o_orderstatus AS sb
        FROM orders x JOIN orders y ON y.o_orderkey = x.o_orderkey + 1),
opairs AS (SELECT a_id, b_id, CASE sa WHEN 'F' THEN 'java' WHEN 'O' THEN 'python' ELSE 'c' END AS language_a,
                  CASE sb WHEN 'F' THEN 'java' WHEN 'O' THEN 'python' ELSE 'c' END AS language_b,
                  floor(least(pa, pb) / greatest(pa, pb) * 100) / 100 AS score FROM op0)
"""

SQL_EVIDENCE = SQL_OUTCOMES + "," + SQL_ORDER_PAIRS + """,
side AS (SELECT frag_id, any_value(arity) AS arity, count(*) AS n FROM oc GROUP BY frag_id),
met AS (SELECT p.a_id, p.b_id, a.sample_idx, a.out_repr, a.out_repr = b.out_repr AS same,
               row_number() OVER (PARTITION BY p.a_id, p.b_id ORDER BY a.sample_idx) AS rk
        FROM opairs p JOIN oc a ON a.frag_id = p.a_id JOIN oc b ON b.frag_id = p.b_id AND b.sample_idx = a.sample_idx),
agg AS (SELECT a_id, b_id, count(*) AS shared, min(rk) FILTER (NOT same) AS first_diff, count(DISTINCT out_repr) AS diverse FROM met GROUP BY a_id, b_id),
ev0 AS (SELECT p.*, x.n AS na, y.n AS nb, x.arity AS aa, y.arity AS ab, coalesce(shared, 0) AS shared, first_diff, coalesce(diverse, 0) AS diverse
        FROM opairs p LEFT JOIN side x ON x.frag_id = p.a_id LEFT JOIN side y ON y.frag_id = p.b_id LEFT JOIN agg USING (a_id, b_id)),
ev1 AS (SELECT *, CASE WHEN na IS NULL OR nb IS NULL OR aa <> ab THEN 'u' WHEN first_diff IS NOT NULL THEN 'd'
                  WHEN shared = 0 AND na >= 3 AND nb >= 3 THEN 'j' WHEN shared >= 3 THEN 'c' ELSE 'i' END AS k FROM ev0),
ev AS (SELECT a_id, b_id, language_a, language_b, score,
              CASE k WHEN 'd' THEN 'different' WHEN 'j' THEN 'different' WHEN 'c' THEN 'consistent' ELSE 'inconclusive' END AS status,
              CAST(CASE k WHEN 'u' THEN 0 WHEN 'd' THEN first_diff ELSE shared END AS INTEGER) AS checked,
              CAST(CASE WHEN k IN ('c', 'i') THEN diverse ELSE 0 END AS INTEGER) AS diverse_outputs FROM ev1)
"""
SQL_DECIDED = """
dec AS (SELECT *, status = 'consistent' AND checked >= 5 AND diverse_outputs >= 3 AS corroborated,
               CASE WHEN score < {cut} THEN 'below' WHEN status = 'different' THEN 'rejected'
                    WHEN (status = 'consistent' AND checked >= 5 AND diverse_outputs >= 3) OR {supported} THEN 'accepted'
                    ELSE 'inconclusive' END AS decision FROM ev)
"""


def eligible(spark, sf):
    return order_pairs(spark, sf).filter(S.semantic_eligible("language_a", "language_b", True, ("c:c",)))


def decided(spark, sf, mode):
    scored = S.evidence_join(order_pairs(spark, sf), outcomes(spark, sf))
    head = 0.6 if mode == "classifier" else None
    ok = ("java:python", "c:c") if mode == "classifier" else ()
    return S.semantic_decide(scored, 0.5, mode, head, ok)


def register(r: B.Registry) -> None:
    # With a threshold of 1 no near-miss is typed, and SQL can tell the rest.
    r.add("all_types", lambda spark, sf: four_types(spark, sf, C.DEFAULT_THRESHOLD))
    r.add("all_types_but_near_misses", lambda spark, sf: four_types(spark, sf, 1.0), SQL_FOUR_TYPES)

    r.add("pair_vectors", lambda spark, sf: S.pair_vectors(vector_pairs(spark, sf), embeddings(spark, sf)).select(
        "a_id", "b_id", F.round(F.col("vec_a")[0].cast("double"), 6).alias("first_a"), F.round(F.col("vec_b")[0].cast("double"), 6).alias("first_b")),
        f"""WITH {SQL_VECTOR_PAIRS} SELECT a_id, b_id, round(x.embedding[1]::DOUBLE, 6) AS first_a, round(y.embedding[1]::DOUBLE, 6) AS first_b
            FROM vpairs JOIN embeddings x ON x.vec_id = a_id JOIN embeddings y ON y.vec_id = b_id""")

    r.add("cosine_pairs", lambda spark, sf: S.cosine_pairs(vector_pairs(spark, sf), S.checked_vectors(embeddings(spark, sf), "vector", 64), 0.1).select(
        "a_id", "b_id", F.round("cosine", 6).alias("cosine")),
        f"""WITH {SQL_VECTOR_PAIRS}, s AS (SELECT a_id, b_id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c
            FROM vpairs JOIN embeddings x ON x.vec_id = a_id JOIN embeddings y ON y.vec_id = b_id)
            SELECT a_id, b_id, round(c, 6) AS cosine FROM s WHERE c >= 0.1""")

    r.add("cosine_join", lambda spark, sf: cosine_join(embeddings(spark, sf), TAU).select("a_id", "b_id", F.round("cosine", 6).alias("cosine")),
          f"""WITH s AS (SELECT x.vec_id AS a_id, y.vec_id AS b_id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c
              FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)
              SELECT a_id, b_id, round(c, 6) AS cosine FROM s WHERE c >= {TAU}""")

    r.add("pair_features", lambda spark, sf: S.pair_vectors(vector_pairs(spark, sf), embeddings(spark, sf)).select(
        "a_id", "b_id", N.pair_features("vec_a", "vec_b").alias("f")).select(
        "a_id", "b_id", F.size("f").cast("bigint").alias("n"), F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), 5).alias("total")),
        f"""WITH {SQL_VECTOR_PAIRS} SELECT a_id, b_id, 2 * len(x.embedding) AS n,
              round(list_sum(list_transform(range(1, 65), lambda i: abs(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE)))
                  + list_sum(list_transform(range(1, 65), lambda i: x.embedding[i]::DOUBLE * y.embedding[i]::DOUBLE)), 5) AS total
            FROM vpairs JOIN embeddings x ON x.vec_id = a_id JOIN embeddings y ON y.vec_id = b_id""")

    r.add("semantic_eligible", lambda spark, sf: eligible(spark, sf).select("a_id", "b_id", "language_a", "language_b"),
          f"""WITH {SQL_ORDER_PAIRS} SELECT a_id, b_id, language_a, language_b FROM opairs
              WHERE (language_a IN ('java', 'python') AND language_b IN ('java', 'python')) OR (language_a = 'c' AND language_b = 'c')""")

    def untyped(spark, sf):
        # Two orders of one customer count as typed by structure.
        o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
        side = lambda s: o.select(F.col("o_orderkey").alias(f"{s}_id"), "o_custkey")
        typed = side("a").join(side("b"), "o_custkey").filter("a_id < b_id")
        return S.untyped_pairs(order_pairs(spark, sf), typed).select("a_id", "b_id")

    r.add("untyped_pairs", untyped, f"""WITH {SQL_ORDER_PAIRS} SELECT a_id, b_id FROM opairs JOIN orders x ON x.o_orderkey = a_id
              JOIN orders y ON y.o_orderkey = b_id WHERE x.o_custkey <> y.o_custkey""")

    r.add("evidence_join", lambda spark, sf: S.evidence_join(order_pairs(spark, sf), outcomes(spark, sf)).select(
        "a_id", "b_id", "status", "checked", "diverse_outputs"),
        f"WITH {SQL_EVIDENCE} SELECT a_id, b_id, status, checked, diverse_outputs FROM ev")

    def aggregated(spark, sf):
        o = outcomes(spark, sf)
        side = lambda s: o.select(F.col("frag_id").alias(f"{s}_id"), "sample_idx", F.col("out_repr").alias(f"out_{s}"))
        met = order_pairs(spark, sf).select("a_id", "b_id").join(side("a"), "a_id").join(side("b"), ["b_id", "sample_idx"])
        return S.evidence_agg(met.select("a_id", "b_id", "sample_idx", F.col("out_a").alias("out_repr"), (F.col("out_a") == F.col("out_b")).alias("same")), "a_id", "b_id")

    r.add("evidence_agg", aggregated, f"""WITH {SQL_EVIDENCE} SELECT a_id, b_id, count(*) AS shared, bool_or(NOT same) AS any_difference,
        count(DISTINCT out_repr) AS diverse_outputs, min(sample_idx) FILTER (NOT same) AS first_difference FROM met GROUP BY a_id, b_id""")

    for mode, cut, supported in (("embedding", 0.7, "false"), ("classifier", 0.6, "least(language_a, language_b) || ':' || greatest(language_a, language_b) IN ('java:python', 'c:c')")):
        sql = f"WITH {SQL_EVIDENCE}, " + SQL_DECIDED.format(cut=cut, supported=supported)
        r.add(f"semantic_decide_{mode}", lambda spark, sf, m=mode: decided(spark, sf, m).select("a_id", "b_id", "decision", "corroborated"),
              sql + " SELECT a_id, b_id, decision, corroborated FROM dec")
        r.add(f"analysis_counters_{mode}", lambda spark, sf, m=mode: S.analysis_counters(decided(spark, sf, m), "language_a"),
              sql + """ SELECT language_a, count(*) AS semantic_pairs_checked, count(*) FILTER (decision = 'rejected') AS behavioral_rejections,
                count(*) FILTER (decision = 'accepted' AND corroborated) AS behavioral_consistent,
                count(*) FILTER (decision = 'inconclusive') AS behavioral_inconclusive,
                count(*) FILTER (decision = 'accepted' AND NOT corroborated) AS classifier_supported FROM dec GROUP BY language_a""")
    r.add("type4_pairs", lambda spark, sf: S.type4_pairs(decided(spark, sf, "classifier"), "classifier").select("a_id", "b_id", "clone_type", "similarity"),
          sql + " SELECT a_id, b_id, 'Type-4' AS clone_type, round(score, 6) AS similarity FROM dec WHERE decision = 'accepted'")

    def modes(spark, sf):
        p = order_pairs(spark, sf)
        mode = F.when(F.col("language_a") == "java", "embedding").when(F.col("language_a") == "c", "classifier").otherwise("structural")
        cut = N.semantic_cutoffs("score", F.lit(0.62), mode)
        return p.select("a_id", "b_id", cut["semantic_threshold"].alias("reported"), cut["corroborated_threshold"].alias("corroborated"), cut["effective"].alias("effective"))

    r.add("resolve_mode", modes, f"""WITH {SQL_ORDER_PAIRS} SELECT a_id, b_id,
        CASE language_a WHEN 'java' THEN greatest(score, 0.85) WHEN 'c' THEN greatest(score, 0.5, 0.62) END AS reported,
        CASE language_a WHEN 'java' THEN greatest(score, 0.7) END AS corroborated,
        CASE language_a WHEN 'java' THEN greatest(score, 0.7) WHEN 'c' THEN greatest(score, 0.5, 0.62) END AS effective FROM opairs""")

    words = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[^\p{L}\p{N}_\s]"
    r.add("hash_features", lambda spark, sf: S.hash_features(B.spread_table(spark, sf, "documents"), "doc_id", "text").select(
        "doc_id", "index", F.round("value", 6).alias("value")),
        f"""WITH wt AS (SELECT doc_id, regexp_extract_all(lower(text), '{words}') AS w FROM documents),
            cl AS (SELECT doc_id, list_transform(w, lambda t: CASE WHEN t IN ({B.quoted(C.STRUCTURAL_KEYWORDS)}) THEN t
                     WHEN regexp_matches(t, '^\\p{{Nd}}+$') THEN 'NUM' WHEN regexp_matches(t, '^[\\p{{L}}_]') THEN 'ID' ELSE t END) AS c FROM wt),
            f AS (SELECT doc_id, unnest(list_concat(c, list_transform(range(1, len(c)), lambda i: c[i] || ':' || c[i + 1]))) AS f FROM cl),
            h AS (SELECT doc_id, ('0x' || md5(f)[1:8])::BIGINT % 768 AS index,
                         CASE WHEN ('0x' || md5(f)[10:10])::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS s FROM f),
            g AS (SELECT doc_id, index, sum(s) AS v FROM h GROUP BY ALL HAVING sum(s) <> 0),
            n AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) AS norm FROM g GROUP BY doc_id)
            SELECT doc_id, index, round(v / norm, 6) AS value FROM g JOIN n USING (doc_id)""")
