"""Copies, renamed copies and near-misses over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.catalog import common as B
from twinspan.functions import text as X
from twinspan.functions.matching import sequence_ratio
from twinspan.operators import copies as K
from twinspan.operators import near_miss as M
from twinspan.operators import rollups as R
from twinspan.operators import segment as G
from twinspan.operators.store import fresh, stage
from twinspan.plans.detect import detect
from twinspan.sources.tables import from_table
from twinspan.streaming.intake import current_copies, current_near_misses, stream_detect

P = B.sql_params()
PS = B.sql_params("source")
PAIRS = ("type1_pairs", "type2_pairs")
NOT_SHARED = "(a.file <> b.file OR a.end_line < b.start_line OR b.end_line < a.start_line)"


def register(r: B.Registry) -> None:
    # Per source, and over all documents as one job: pairs between sources count in the latter alone.
    for name, by_source, tokens in (("candidate_pair_count", True, B.sql_tokens("source")), ("candidate_pair_count_one_job", False, B.sql_tokens())):
        r.add(name, lambda spark, sf, own=by_source: B.counts(K.candidate_pair_count(G.usable_fragments(B.tokenised(spark, sf, own))), "candidate_pairs"),
              f"""WITH {tokens} SELECT a.job_id, count(*) AS candidate_pairs FROM usable a JOIN usable b
              ON a.job_id = b.job_id AND (a.file_ord, a.start_line, a.end_line) < (b.file_ord, b.start_line, b.end_line)
              AND {NOT_SHARED} GROUP BY a.job_id""")

    r.add("overlapping_fragments", lambda spark, sf: K.overlapping_fragments(G.usable_fragments(B.tokenised(spark, sf))).select("frag_id_a", "frag_id_b"),
          f"""WITH {B.sql_tokens()} SELECT a.frag_id AS frag_id_a, b.frag_id AS frag_id_b FROM usable a JOIN usable b
              ON a.file = b.file AND (a.start_line, a.end_line) < (b.start_line, b.end_line) AND a.end_line >= b.start_line""")

    def flat(df, fp):
        return df.select("language", "n_members", F.col("anchor.frag_id").alias("anchor"))

    for name, level, column in (("exact_copy_classes", "tokens", "tokens"), ("renamed_copy_classes", "params", "params")):
        r.add(name, lambda spark, sf, lv=level: flat(K.clone_classes(B.prints(spark, sf), lv), lv),
              f"""WITH {P} SELECT language, count(*) AS n_members, arg_min(frag_id, (file_ord, start_line, end_line)) AS anchor
                  FROM prints GROUP BY language, {column} HAVING count(*) > 1""")

    r.add("class_members", lambda spark, sf: K.class_members(stage(B.prints(spark, sf).drop("tokens", "params", "near", "code"), "prints"), "tokens").select(
        "frag_id", F.col("anchor.frag_id").alias("anchor"), "n_members", "is_anchor", "overlaps_anchor"),
        f"""WITH {P}, c AS (SELECT language, tokens, count(*) AS n_members, arg_min(frag_id, (file_ord, start_line, end_line)) AS anchor
                  FROM prints GROUP BY language, tokens HAVING count(*) > 1)
            SELECT p.frag_id, anchor, n_members, p.frag_id = anchor AS is_anchor,
                   p.frag_id <> anchor AND p.file = a.file AND p.start_line <= a.end_line AND a.start_line <= p.end_line AS overlaps_anchor
            FROM prints p JOIN c USING (language, tokens) JOIN prints a ON a.frag_id = c.anchor""")

    slim = lambda spark, sf, s=False: stage(B.prints(spark, sf, s).drop("tokens", "params", "near", "code"), "prints")
    r.add("copy_pair_totals", lambda spark, sf: B.counts(K.copy_pair_totals(slim(spark, sf)), *PAIRS),
          f"""WITH {P} SELECT 'all' AS job_id, count(*) FILTER (a.tokens = b.tokens) AS type1_pairs,
                     count(*) FILTER (a.tokens <> b.tokens) AS type2_pairs
              FROM prints a JOIN prints b ON a.language = b.language AND a.params = b.params
               AND (a.file_ord, a.start_line, a.end_line) < (b.file_ord, b.start_line, b.end_line) AND {NOT_SHARED}""")

    r.add("copy_pairs_by_file", lambda spark, sf: B.counts(K.copy_pairs_by_file(slim(spark, sf)), *PAIRS),
          f"""WITH {P}, q AS (SELECT unnest(list_distinct([a.file, b.file])) AS file, a.tokens = b.tokens AS same
              FROM prints a JOIN prints b ON a.language = b.language AND a.params = b.params
               AND (a.file_ord, a.start_line, a.end_line) < (b.file_ord, b.start_line, b.end_line) AND {NOT_SHARED})
              SELECT 'all' AS job_id, file, count(*) FILTER (same) AS type1_pairs, count(*) FILTER (NOT same) AS type2_pairs FROM q GROUP BY file""")

    links = f"""WITH {P},
        e AS (SELECT language, params, tokens, arg_min(frag_id, (file_ord, start_line, end_line)) AS hub,
                     min((file_ord, start_line, end_line)) AS o FROM prints GROUP BY language, params, tokens),
        q AS (SELECT language, params, arg_min(hub, o) AS top FROM e GROUP BY language, params)
        SELECT 'Type-1' AS clone_type, hub AS frag_id_a, p.frag_id AS frag_id_b FROM prints p JOIN e USING (language, params, tokens) WHERE p.frag_id <> hub
        UNION ALL SELECT 'Type-2', top, hub FROM e JOIN q USING (language, params) WHERE top <> hub"""
    r.add("copy_links", lambda spark, sf: K.copy_links(slim(spark, sf)).select("clone_type", "frag_id_a", "frag_id_b"), links)

    def typed_union(spark, sf, by_source):
        f = slim(spark, sf, by_source)
        links = K.copy_links(f)
        one, two = links.filter("clone_type = 'Type-1'"), links.filter("clone_type = 'Type-2'")
        both = R.type_counts(K.union_typed(one, two))
        return both.select("job_id", F.col("type1_count").alias("type1_links"), F.col("type2_count").alias("type2_links"))

    for name, prints in (("union_typed", PS), ("union_typed_one_job", P)):
        r.add(name, lambda spark, sf, own=prints is PS: typed_union(spark, sf, own), f"""WITH {prints},
        c AS (SELECT job_id, language, params, count(*) AS n, count(DISTINCT tokens) AS d FROM prints GROUP BY ALL HAVING count(*) > 1)
        SELECT job_id, CAST(sum(n - d) AS BIGINT) AS type1_links, CAST(sum(d - 1) AS BIGINT) AS type2_links FROM c GROUP BY job_id""")

    # All pairs, listed: quadratic output, so within sources.
    def listed(spark, sf):
        return K.expand_pairs(slim(spark, sf, True)).select("job_id", "clone_type", "frag_id_a", "frag_id_b")

    r.add("pairs", listed, f"""WITH {PS} SELECT a.job_id, CASE WHEN a.tokens = b.tokens THEN 'Type-1' ELSE 'Type-2' END AS clone_type,
              a.frag_id AS frag_id_a, b.frag_id AS frag_id_b
              FROM prints a JOIN prints b ON a.job_id = b.job_id AND a.language = b.language AND a.params = b.params
               AND (a.file_ord, a.start_line, a.end_line) < (b.file_ord, b.start_line, b.end_line) AND {NOT_SHARED}""")

    # Near-misses: the score has no SQL form, so rows only; tests compare with brute force.
    def near(spark, sf):
        f = stage(B.prints(spark, sf, True).drop("tokens", "params", "code"), "prints")
        return M.near_miss_join(f).select(
            "job_id", "language", F.col("rep_a.frag_id").alias("frag_id_a"), F.col("rep_b.frag_id").alias("frag_id_b"),
            F.round("similarity", 6).alias("similarity"), F.col("n_pairs").cast("bigint").alias("n_pairs"))

    r.add("near_miss_join", near)

    # All documents as one job.
    def near_over_all(spark, sf):
        f = stage(B.prints(spark, sf).drop("tokens", "params", "code"), "prints")
        return M.near_miss_join(f).select(
            "language", F.col("rep_a.frag_id").alias("frag_id_a"), F.col("rep_b.frag_id").alias("frag_id_b"),
            F.round("similarity", 6).alias("similarity"), F.col("n_pairs").cast("bigint").alias("n_pairs"))

    r.add("near_miss_join_one_job", near_over_all)

    def bags(spark, sf):
        d = B.spread_table(spark, sf, "documents").select("doc_id", X.tokens("text").alias("toks"))
        return M.bag_overlap_join(d, "doc_id", "toks", 0.8).select("doc_id_a", "doc_id_b", "shared", F.round("overlap", 6).alias("overlap"))

    r.add("bag_overlap_join", bags, f"""
        WITH e AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, {B.pattern(C.TOKEN_PATTERN_PLAIN)}),
                     lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*'))) AS t FROM documents),
        c AS (SELECT doc_id, t, count(*) AS n, CASE WHEN t IN ({B.quoted(C.DELIMITERS)}) THEN 1 WHEN starts_with(t, 'ID_') THEN 5 ELSE 10 END AS w FROM e GROUP BY ALL),
        tot AS (SELECT doc_id, sum(n * w) AS weight FROM c GROUP BY doc_id),
        s AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, CAST(sum(a.w * least(a.n, b.n)) AS BIGINT) AS shared
              FROM c a JOIN c b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL)
        SELECT doc_id_a, doc_id_b, shared, round(2 * shared / (x.weight + y.weight), 6) AS overlap
        FROM s JOIN tot x ON x.doc_id = doc_id_a JOIN tot y ON y.doc_id = doc_id_b
        WHERE 2 * shared / (x.weight + y.weight) >= 0.8 - 1e-9""")

    # The filter stage of the near-miss join on the shapes of each source, checked in full.
    def shape_bags(spark, sf, by_source):
        f = M.shapes(B.prints(spark, sf, by_source)).withColumn("shape", F.md5(F.array_join("toks", " ").cast("binary")))
        f = f.withColumn("shape", F.concat_ws("/", "job_id", "language", "shape"))
        return M.bag_overlap_join(f.drop("cid"), "shape", "toks", C.NEAR_MISS_FLOOR).select(
            "shape_a", "shape_b", "shared", F.round("overlap", 6).alias("overlap"))

    for name, prints in (("near_miss_bag_filter", PS), ("near_miss_bag_filter_one_job", P)):
        r.add(name, lambda spark, sf, own=prints is PS: shape_bags(spark, sf, own), f"""
        WITH {prints}, sh AS (SELECT DISTINCT job_id, language, params FROM prints),
        k AS (SELECT job_id, language, params, job_id || '/' || language || '/' || md5(array_to_string(params, ' ')) AS shape FROM sh),
        e AS (SELECT job_id, language, shape, unnest(params) AS t FROM k),
        c AS (SELECT job_id, language, shape, t, count(*) AS n, CASE WHEN t IN ({B.quoted(C.DELIMITERS)}) THEN 1 WHEN starts_with(t, 'ID_') THEN 5 ELSE 10 END AS w FROM e GROUP BY ALL),
        tot AS (SELECT shape, sum(n * w) AS weight FROM c GROUP BY shape),
        s AS (SELECT a.shape AS shape_a, b.shape AS shape_b, CAST(sum(a.w * least(a.n, b.n)) AS BIGINT) AS shared
              FROM c a JOIN c b ON a.job_id = b.job_id AND a.language = b.language AND a.t = b.t AND a.shape < b.shape GROUP BY ALL)
        SELECT shape_a, shape_b, shared, round(2 * shared / (x.weight + y.weight), 6) AS overlap
        FROM s JOIN tot x ON x.shape = shape_a JOIN tot y ON y.shape = shape_b
        WHERE 2 * shared / (x.weight + y.weight) >= 0.75 - 1e-9""")

    def ratios(spark, sf):
        c = B.table(spark, sf, "conversations").select("conv_id", "turn", X.tokens("text").alias("toks"))
        a = c.select("conv_id", "turn", F.col("toks").alias("a"))
        b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("toks").alias("b"))
        return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(sequence_ratio("a", "b"), 6).alias("token_sim"))

    # Longest run first, earliest in the first side, then in the second; then what lies before and behind it.
    r.add("sequence_ratio", ratios, f"""
        WITH RECURSIVE tok AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, {B.pattern(C.TOKEN_PATTERN_PLAIN)}),
                                 lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*')) AS toks FROM conversations),
        pr AS (SELECT x.conv_id, x.turn, x.toks AS a, y.toks AS b FROM tok x JOIN tok y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
        ea AS (SELECT conv_id, turn, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM pr),
        eb AS (SELECT conv_id, turn, unnest(b) AS t, generate_subscripts(b, 1) AS j FROM pr),
        hit AS (SELECT conv_id, turn, i, j FROM ea JOIN eb USING (conv_id, turn, t)),
        run AS (SELECT conv_id, turn, i, j, row_number() OVER (PARTITION BY conv_id, turn, j - i ORDER BY i) - i AS g FROM hit),
        runs AS MATERIALIZED (SELECT conv_id, turn, min(i) AS i, min(j) AS j, count(*) AS n FROM run GROUP BY conv_id, turn, j - i, g),
        seg AS (
          SELECT conv_id, turn, 1 AS a0, len(a) + 1 AS a1, 1 AS b0, len(b) + 1 AS b1, 0 AS got FROM pr
          UNION ALL
          SELECT conv_id, turn, CASE side WHEN 0 THEN a0 ELSE best.x + best.n END, CASE side WHEN 0 THEN best.x ELSE a1 END,
                 CASE side WHEN 0 THEN b0 ELSE best.y + best.n END, CASE side WHEN 0 THEN best.y ELSE b1 END, CASE side WHEN 0 THEN best.n ELSE 0 END
          FROM (SELECT conv_id, turn, a0, a1, b0, b1, arg_max({{'x': x, 'y': y, 'n': n}}, (n, -x, -y)) AS best
                FROM (SELECT s.*, r.i + k AS x, r.j + k AS y, least(r.n - k, a1 - r.i - k, b1 - r.j - k) AS n
                      FROM (SELECT s.conv_id, s.turn, a0, a1, b0, b1 FROM seg s) s JOIN runs r ON r.conv_id = s.conv_id AND r.turn = s.turn,
                           LATERAL (SELECT greatest(a0 - r.i, b0 - r.j, 0) AS k) o) c
                WHERE n > 0 GROUP BY ALL) m, (VALUES (0), (1)) v(side))
        SELECT p.conv_id, p.turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(2 * got / (len(a) + len(b)), 6) END AS token_sim
        FROM pr p JOIN (SELECT conv_id, turn, sum(got) AS got FROM seg GROUP BY ALL) g USING (conv_id, turn)""")

    def links_of(spark, sf, by_source):
        return B.counts(detect(B.files(spark, sf, by_source), python_lexer=False).links(), "n_pairs").select(
            "job_id", "clone_type", "file_a", "file_b", "start_line_a", "end_line_a", "start_line_b", "end_line_b",
            "similarity", "token_sim", "cross_language", "description", "n_pairs")

    def totals(spark, sf, by_source):
        return B.counts(detect(B.files(spark, sf, by_source), python_lexer=False).totals(), "candidate_pairs", *PAIRS, "type3_pairs")

    # The documents in four parts, one after the other: what is current at the end is what one run over all gives.
    def streamed(spark, sf, near_misses):
        given = B.table(spark, sf, "documents")
        at = fresh(spark, "stream-detect")
        given.repartitionByRange(4, "doc_id").write.parquet(f"{at}/in")
        stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        files = from_table(stream, B.file_name(), "text", "lang", "doc_id", "source")
        stream_detect(files, f"{at}/corpus", f"{at}/links", f"{at}/state", python_lexer=False, near_misses=near_misses).awaitTermination()
        return spark.read.parquet(f"{at}/links/{'near' if near_misses else 'copies'}")

    r.add("stream_copies", lambda spark, sf: current_copies(streamed(spark, sf, False)).select("job_id", "clone_type", "frag_id_a", "frag_id_b"), f"""WITH {PS},
        e AS (SELECT job_id, language, params, tokens, arg_min(frag_id, (file_ord, start_line, end_line)) AS hub,
                     min((file_ord, start_line, end_line)) AS o FROM prints GROUP BY job_id, language, params, tokens),
        q AS (SELECT job_id, language, params, arg_min(hub, o) AS top FROM e GROUP BY job_id, language, params)
        SELECT job_id, 'Type-1' AS clone_type, hub AS frag_id_a, p.frag_id AS frag_id_b FROM prints p JOIN e USING (job_id, language, params, tokens) WHERE p.frag_id <> hub
        UNION ALL SELECT job_id, 'Type-2', top, hub FROM e JOIN q USING (job_id, language, params) WHERE top <> hub""")

    # The score has no SQL form that ends in time; a test holds it against one run over everything.
    r.add("stream_detect", lambda spark, sf: current_near_misses(streamed(spark, sf, True)).select(
        "job_id", "language", F.col("rep_a.frag_id").alias("frag_id_a"), F.col("rep_b.frag_id").alias("frag_id_b"),
        F.round("similarity", 6).alias("similarity"), F.col("n_pairs").cast("bigint").alias("n_pairs")))

    for suffix, prints in (("", PS), ("_one_job", P)):
        r.add(f"detect{suffix}", lambda spark, sf, own=prints is PS: links_of(spark, sf, own))
        r.add(f"detect_totals{suffix}", lambda spark, sf, own=prints is PS: totals(spark, sf, own))
        r.add(f"detect_structural_totals{suffix}", lambda spark, sf, own=prints is PS: totals(spark, sf, own).drop("type3_pairs"),
              f"""WITH {prints}, n AS (SELECT t.job_id, count(*) AS fragments, count(u.frag_id) AS usable FROM tok t LEFT JOIN usable u USING (job_id, frag_id) GROUP BY t.job_id),
              c AS (SELECT a.job_id, count(*) AS candidate_pairs,
                           count(*) FILTER (a.language = b.language AND a.tokens = b.tokens) AS type1_pairs,
                           count(*) FILTER (a.language = b.language AND a.params = b.params AND a.tokens <> b.tokens) AS type2_pairs
                    FROM prints a JOIN prints b ON a.job_id = b.job_id
                     AND (a.file_ord, a.start_line, a.end_line) < (b.file_ord, b.start_line, b.end_line) AND {NOT_SHARED} GROUP BY a.job_id)
              SELECT * FROM n JOIN c USING (job_id)""")
