"""Sources and scalar expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinspan import constants as C
from twinspan.catalog import common as B
from twinspan.functions import numeric as N
from twinspan.functions import text as X
from twinspan.functions.renaming import rename_identifiers
from twinspan.operators import rollups as R
from twinspan.operators import segment
from twinspan.operators.segment import once
from twinspan.session import checkpoint_dir
from twinspan.sources import embeddings as cache
from twinspan.sources import tables as S

T = B.sql_tokens()
P = B.sql_params()


def register(r: B.Registry) -> None:
    # --- sources
    def bound(spark, sf):
        return S.from_table(B.table(spark, sf, "documents"), B.file_name(), "text", "lang", "doc_id", "source").select(
            "job_id", "file", "file_ord", "language", F.length("content").alias("n"))

    r.add("from_table", bound, """
        SELECT source AS job_id, source || '/' || doc_id || '.txt' AS file, doc_id AS file_ord, lang AS language,
               length(text) AS n FROM documents""")

    def paths(spark, sf):
        p = B.table(spark, sf, "pages").select("page_id", F.translate("url", "/", "\\").alias("u"))
        p = p.withColumn("path", X.normalise_path("u"))
        parts = X.path_parts("path")
        return p.select("page_id", "path", parts["name"].alias("name"), parts["dir"].alias("dir"), parts["ext"].alias("ext"))

    r.add("path_parts", paths, r"""
        WITH p AS (SELECT page_id, regexp_replace(replace(replace(url, '/', '\'), '\', '/'), '^/+', '') AS path FROM pages)
        SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS dir,
               upper(split_part(regexp_extract(path, '[^/]*$'), '.', -1)) AS ext FROM p""")

    def languages(spark, sf):
        ext = F.element_at(F.array(*[F.lit(e) for e in ("py", "JAVA", "c", "h", "txt", "md")]), (F.col("doc_id") % 6 + 1).cast("int"))
        d = B.table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/f."), ext).alias("file"))
        return S.supported_only(d).select("doc_id", "file", X.detect_language("file").alias("language"))

    ext_sql = "(['py', 'JAVA', 'c', 'h', 'txt', 'md'])[doc_id % 6 + 1]"
    r.add("detect_language", languages, f"""
        SELECT doc_id, source || '/f.' || {ext_sql} AS file,
               CASE lower({ext_sql}) WHEN 'py' THEN 'python' WHEN 'java' THEN 'java' ELSE 'c' END AS language
        FROM documents WHERE lower({ext_sql}) IN ('py', 'java', 'c', 'h')""")

    def ingest(spark, sf):
        ext = F.element_at(F.array(*[F.lit(e) for e in ("py", "JAVA", "c", "h", "txt", "md")]), (F.col("doc_id") % 6 + 1).cast("int"))
        d = B.table(spark, sf, "documents").select(F.col("source").alias("job_id"), F.concat(F.lit("/f."), ext).alias("file"))
        return S.ingest_counts(d)

    r.add("ingest_counts", ingest, f"""
        SELECT source AS job_id, count(*) AS total,
               count(*) FILTER (lower({ext_sql}) IN ('py', 'java', 'c', 'h')) AS code_files,
               count(*) FILTER (lower({ext_sql}) NOT IN ('py', 'java', 'c', 'h')) AS skipped_files
        FROM documents GROUP BY source""")

    def decoded(spark, sf):
        d = B.table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
        return d.select("doc_id", F.md5(X.decode_source("raw", True).cast("binary")).alias("digest"))

    r.add("decode_source", decoded, "SELECT doc_id, md5(text) AS digest FROM documents")

    def sizes(spark, sf):
        d = B.table(spark, sf, "documents")
        n = F.octet_length("text")
        return d.select("doc_id", X.size_kb("text").alias("size_kb"),
                        F.when(n > 1024, "KB").otherwise(X.size_label(n)).alias("label"))

    r.add("size_kb", sizes, """
        SELECT doc_id, round(strlen(text) / 1024, 2) AS size_kb,
               CASE WHEN strlen(text) > 1024 THEN 'KB' ELSE strlen(text) || ' B' END AS label FROM documents""")

    def small(spark, sf):
        return S.check_file_size(B.files(spark, sf), 0.004, "drop").select("file")

    r.add("check_file_size", small, """
        SELECT source || '/' || doc_id || '.txt' AS file FROM documents WHERE strlen(text) <= CAST(floor(0.004 * 1048576) AS BIGINT)""")

    def repeated(spark, sf):
        d = B.table(spark, sf, "documents").select(
            F.col("lang").alias("job_id"), F.concat(F.lit("/"), "source", F.lit("/"), (F.col("n_chars") % 50).cast("string")).alias("file"))
        return S.duplicate_paths(d)

    r.add("check_duplicate_paths", repeated, """
        SELECT lang AS job_id, source || '/' || (n_chars % 50) AS file, count(*) AS n
        FROM documents GROUP BY ALL HAVING count(*) > 1""")

    def first_paths(spark, sf):
        d = B.table(spark, sf, "documents").select(
            F.col("lang").alias("job_id"), F.concat("source", F.lit("/"), (F.col("n_chars") % 50).cast("string")).alias("file"),
            F.col("doc_id").alias("file_ord"), F.col("text").alias("content"))
        return S.first_of_each_path(d).select("job_id", "file", "file_ord")

    r.add("first_of_each_path", first_paths, """
        SELECT lang AS job_id, source || '/' || (n_chars % 50) AS file, min(doc_id) AS file_ord FROM documents GROUP BY ALL""")

    # The file of line item 1 of order 7, asked for by its owner and by somebody else.
    def lookup(spark, sf):
        files = B.table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("job_id"), F.concat(F.lit("line/"), F.col("l_linenumber").cast("string"), F.lit(".c")).alias("file"),
            F.lit("c").alias("language"), F.concat_ws("/", F.col("l_partkey").cast("string"), "l_returnflag").alias("content"))
        jobs = B.jobs(spark, sf)
        owner = jobs.filter("job_id = 7").agg(F.max("user_id")).scalar()
        ask = lambda who, user: S.lookup_source(files, jobs, 7, user, "line/1.c").select(F.lit(who).alias("asked_by"), "file", "language", "content")
        return ask("owner", owner).unionByName(ask("other", owner + 1))

    r.add("lookup_source", lookup, f"""
        WITH {B.SQL_JOBS}
        SELECT 'owner' AS asked_by, 'line/' || l_linenumber || '.c' AS file, 'c' AS language, l_partkey || '/' || l_returnflag AS content
        FROM lineitem JOIN jobs ON job_id = l_orderkey WHERE l_orderkey = 7 AND l_linenumber = 1""")

    def misses(spark, sf):
        frags = B.table(spark, sf, "documents").select(F.col("text").alias("code"), F.col("lang").alias("language"), "doc_id")
        quality = B.table(spark, sf, "labels").select("doc_id", "quality")
        known = frags.join(quality, "doc_id").select(
            cache.code_key().alias("key"), F.array_repeat(F.lit(0.5), 4 + F.col("quality").cast("int")).alias("vector"))
        known = cache.valid_cache(known, 4).select("key").distinct()
        missing = cache.cache_misses(frags, known)
        return missing.agg(F.count("*").alias("misses"), F.first(known.agg(F.count("*")).scalar()).alias("valid_rows"))

    r.add("embedding_cache", misses, """
        WITH k AS (SELECT DISTINCT text FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
        SELECT (SELECT count(DISTINCT text) FROM documents WHERE text NOT IN (SELECT text FROM k)) AS misses,
               (SELECT count(*) FROM k) AS valid_rows""")

    def embedded(spark, sf):
        """All documents through a bucketed cache that knows the texts of quality 0."""
        frags = B.table(spark, sf, "documents").select(F.col("text").alias("code"), F.col("lang").alias("language"), "doc_id")
        known = frags.join(B.table(spark, sf, "labels").filter("quality = 0").select("doc_id"), "doc_id")
        store = cache.EmbeddingCache(spark, f"{checkpoint_dir(spark)}/embedding-cache-{uuid.uuid4().hex}", buckets=16)
        store.append(known.select(
            cache.code_key().alias("key"), F.array_repeat(F.lit(0.5), 4).alias("vector"), F.current_timestamp().alias("stored_at")).distinct())
        length = F.length("code").cast("double")
        out = store.embed(frags, lambda rows: rows.select("key", F.array(length, F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("vector")), 4)
        return out.select("doc_id", F.col("vector")[0].alias("first"), F.col("vector")[3].alias("last"))

    r.add("embed_with_cache", embedded, """
        WITH k AS (SELECT DISTINCT text FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
        SELECT doc_id, CASE WHEN k.text IS NULL THEN CAST(length(d.text) AS DOUBLE) ELSE 0.5 END AS first,
               CASE WHEN k.text IS NULL THEN 0.0::DOUBLE ELSE 0.5 END AS last
        FROM documents d LEFT JOIN k ON k.text = d.text""")

    # --- tokens
    def token_lists(spark, sf):
        return B.tokenised(spark, sf).select("frag_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))

    r.add("tokens_regex", token_lists, f"WITH {T} SELECT frag_id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM tok")

    def turns_normalised(spark, sf):
        c = B.table(spark, sf, "conversations")
        return c.select("conv_id", "turn", F.md5(X.normalise_text("text").cast("binary")).alias("digest"))

    r.add("normalise_text", turns_normalised, r"""
        SELECT conv_id, turn, md5(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM conversations""")

    def keyword_use(spark, sf):
        t = B.tokenised(spark, sf).select("language", F.explode("tokens").alias("t"))
        return t.groupBy("language").agg(F.count("*").alias("tokens"), F.count_if(X.is_keyword(F.col("t"))).alias("keywords"))

    r.add("is_keyword", keyword_use, f"""
        WITH {T}, e AS (SELECT language, unnest(tokens) AS t FROM tok)
        SELECT language, count(*) AS tokens, count(*) FILTER (t IN ({B.quoted(C.KEYWORDS)})) AS keywords FROM e GROUP BY language""")

    def renamed(spark, sf):
        f = segment.usable_fragments(B.tokenised(spark, sf))
        f = once(f, "params", rename_identifiers("tokens"))
        return f.select("frag_id", F.md5(F.array_join("params", " ").cast("binary")).alias("digest"))

    r.add("parameterize", renamed, f"WITH {P} SELECT frag_id, md5(array_to_string(params, ' ')) AS digest FROM prints")

    def restored(spark, sf):
        f = B.prints(spark, sf)
        return f.select("frag_id", F.md5(F.array_join("near", " ").cast("binary")).alias("digest"), X.total_weight("near").alias("weight"))

    r.add("near_miss_tokens", restored, f"""
        WITH {P}, w AS (
          SELECT frag_id, CAST(sum(CASE WHEN t IN ({B.quoted(C.DELIMITERS)}) THEN 1 WHEN starts_with(t, 'ID_') THEN 5 ELSE 10 END) AS BIGINT) AS weight
          FROM (SELECT frag_id, unnest(near) AS t FROM prints) GROUP BY frag_id)
        SELECT frag_id, md5(array_to_string(near, ' ')) AS digest, weight FROM prints JOIN w USING (frag_id)""")

    def same_prints(spark, sf):
        f = segment.usable_fragments(B.tokenised(spark, sf))
        return f.select("language", X.fingerprint("tokens").alias("fp")).groupBy("language").agg(
            F.count("*").alias("fragments"), F.countDistinct("fp").alias("distinct_fragments"))

    r.add("fingerprint", same_prints, f"""
        WITH {T} SELECT language, count(*) AS fragments, count(DISTINCT tokens) AS distinct_fragments FROM usable GROUP BY language""")

    def stripped(spark, sf):
        p = B.table(spark, sf, "pages")
        return p.select("page_id", F.md5(X.strip_comments("html").cast("binary")).alias("digest"))

    r.add("strip_comments", stripped, f"""
        WITH s AS (SELECT page_id, list_transform(regexp_extract_all(html, {B.pattern(C.CODE_SEGMENT_PATTERN_PLAIN)}),
                     lambda p: CASE WHEN starts_with(p, '//') OR starts_with(p, '/*') THEN ' ' ELSE p END) AS parts FROM pages)
        SELECT page_id, md5(array_to_string(list_filter(string_split(array_to_string(parts, ''), chr(10)),
                     lambda x: regexp_matches(x, '\\S')), chr(10))) AS digest FROM s""")

    words = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[^\p{L}\p{N}_\s]"
    cls = f"""
        wt AS (SELECT doc_id, regexp_extract_all(lower(text), '{words}') AS w FROM documents),
        cl AS (SELECT doc_id, w, list_transform(w, lambda t: CASE WHEN t IN ({B.quoted(C.STRUCTURAL_KEYWORDS)}) THEN t
                 WHEN regexp_matches(t, '^\\p{{Nd}}+$') THEN 'NUM' WHEN regexp_matches(t, '^[\\p{{L}}_]') THEN 'ID' ELSE t END) AS c FROM wt)"""

    def classes(spark, sf):
        d = once(B.spread_table(spark, sf, "documents").select("doc_id", "text"), "w", X.word_tokens_lower("text"))
        d = once(d, "c", X.structural_class("w"))
        return d.select(
            "doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"),
            F.md5(F.array_join("c", " ").cast("binary")).alias("classes"),
            F.md5(F.array_join(X.bigrams("c"), " ").cast("binary")).alias("bigrams"))

    r.add("structural_classes", classes, f"""
        WITH {cls}
        SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words, md5(array_to_string(c, ' ')) AS classes,
               md5(array_to_string(list_transform(range(1, len(c)), lambda i: c[i] || ':' || c[i + 1]), ' ')) AS bigrams FROM cl""")

    def cosines(spark, sf):
        e = B.table(spark, sf, "embeddings").select("vec_id", "embedding")
        p = B.pair_up(e, "vec_id", "embedding")
        return p.select("vec_id_a", "vec_id_b", F.round(N.cosine("embedding_a", "embedding_b"), 6).alias("cosine"))

    r.add("cosine", cosines, """
        SELECT x.vec_id AS vec_id_a, y.vec_id AS vec_id_b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine
        FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1""")

    def blank_lines(spark, sf):
        return B.table(spark, sf, "documents").select("doc_id", X.nonblank_line_count("text").alias("n"))

    r.add("nonblank_line_count", blank_lines, r"""
        SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS n FROM documents""")

    def described(spark, sf):
        p = B.file_pairs(spark, sf)
        return p.select(
            "id_a", "id_b", X.language_pair("language_a", "language_b").alias("languages"),
            X.pair_key("file_b", "file_a")["lo"].alias("lo"), X.pair_key("file_b", "file_a")["hi"].alias("hi"),
            X.clone_description("clone_type", "cross_language").alias("description"),
            X.type4_description(F.lit("embedding"), F.col("n_sum") % 2 == 0, F.col("n_sum") % 20).alias("type4"))

    d = C.TYPE_DESCRIPTIONS
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items())
    r.add("clone_description", described, f"""
        WITH {B.SQL_FILE_PAIRS}
        SELECT id_a, id_b, least(language_a, language_b) || ':' || greatest(language_a, language_b) AS languages,
               least(file_a, file_b) AS lo, greatest(file_a, file_b) AS hi,
               CASE WHEN cross_language AND clone_type = 'Type-4' THEN '{C.CROSS_LANGUAGE_TYPE4}'
                    ELSE (CASE clone_type {cases} END) || CASE WHEN cross_language THEN '{C.CROSS_LANGUAGE_SUFFIX}' ELSE '' END END AS description,
               'Type-4 candidate — base-model semantic similarity; ' || CASE WHEN n_sum % 2 = 0
                 THEN (n_sum % 20) || ' bounded Python samples agree; not proof of equivalence'
                 ELSE 'evaluated classifier for this language pair; behavior unverified; review required' END AS type4 FROM pairs""")

    def info(spark, sf):
        e = B.table(spark, sf, "events").withColumn("k", F.from_json("props", "k INT")["k"])
        record = F.struct(F.col("event_type").alias("mode"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("checked"),
                          F.struct(F.lit("complete").alias("stage")).alias("progress"))
        return e.select("event_id", R.analysis_info_json(record).alias("json"))

    r.add("analysis_info_json", info, """
        SELECT event_id, '{"mode":"' || event_type || '","checked":' || CASE WHEN CAST(props->>'k' AS INTEGER) % 2 = 0 THEN props->>'k' ELSE 'null' END
               || ',"progress":{"stage":"complete"}}' AS json FROM events""")

    def figures(spark, sf):
        p = B.file_pairs(spark, sf)
        return p.select(
            "id_a", "id_b", N.pct("similarity").alias("percent"), F.round(N.round6(F.col("similarity") / 3), 4).alias("rounded"),
            F.round(N.clamp_threshold("similarity"), 4).alias("clamped"),
            F.length(X.truncate_error(F.repeat("file_a", (F.col("n_sum") % 300).cast("int")))).alias("error_length"))

    r.add("display_figures", figures, f"""
        WITH {B.SQL_FILE_PAIRS}
        SELECT id_a, id_b, CAST(floor(similarity * 100 + 0.5) AS INTEGER) AS percent, round(similarity / 3, 4) AS rounded,
               round(greatest(0.3, least(0.99, similarity)), 4) AS clamped,
               length(substr(repeat(file_a, n_sum % 300), 1, 2000)) AS error_length FROM pairs""")

    r.add("created_date", lambda spark, sf: B.jobs(spark, sf).groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n")), f"""
        WITH {B.SQL_JOBS} SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM jobs GROUP BY day""")

    def wilson(spark, sf):
        o = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
        return o.select("o_custkey", F.round(N.wilson_lower("k", "n"), 6).alias("lower"))

    r.add("wilson_lower", wilson, """
        WITH o AS (SELECT o_custkey, count(*)::DOUBLE AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k FROM orders GROUP BY o_custkey)
        SELECT o_custkey, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)))
               / (1 + 1.96 * 1.96 / n), 6) AS lower FROM o""")

    def vector_mask(spark, sf):
        e = B.table(spark, sf, "embeddings")
        v = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * 0)).when(
            F.col("vec_id") % 7 == 1, F.transform("embedding", lambda x: F.lit(float("inf")).cast("float"))).otherwise(F.col("embedding"))
        return e.select("vec_id", F.coalesce(N.valid_vector(v, 64), F.lit(False)).alias("valid"),
                        N.valid_score(F.col("embedding")[0].cast("double") * 4).alias("valid_score"))

    r.add("valid_vector", vector_mask, """
        SELECT vec_id, vec_id % 7 NOT IN (0, 1) AS valid, embedding[1]::DOUBLE * 4 BETWEEN 0 AND 1 AS valid_score FROM embeddings""")

    def span_overlaps(spark, sf):
        li = B.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("k"), F.col("l_quantity").cast("int").alias("q"))
        start, end = F.col("k") % 40, F.col("k") % 40 + F.col("q")
        return li.select(
            "l_orderkey", "k", "q",
            X.overlaps(F.lit("f"), start, end, F.lit("f"), F.col("q"), F.col("q") + 10).alias("overlap"),
            F.size(X.line_range(start, end)).alias("lines"))

    r.add("overlaps", span_overlaps, """
        SELECT l_orderkey, l_partkey AS k, CAST(l_quantity AS INTEGER) AS q,
               l_partkey % 40 <= CAST(l_quantity AS INTEGER) + 10 AND CAST(l_quantity AS INTEGER) <= l_partkey % 40 + CAST(l_quantity AS INTEGER) AS overlap,
               CAST(l_quantity AS INTEGER) + 1 AS lines FROM lineitem""")

    def lexed(spark, sf):
        c = B.spread_table(spark, sf, "conversations").select("conv_id", "turn", F.lit("python").alias("language"), F.col("text").alias("code"))
        return segment.with_tokens(c).select("conv_id", "turn", F.size("tokens").alias("n"))

    r.add("python_tokens", lexed)
