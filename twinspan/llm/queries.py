"""The operators of this folder as registered queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.catalog.common import Registry, table
from twinspan.llm import (
    chat_format, collocations, license_scan, minhash_dedup, mixing, periodic_runs, quality_rules, sentencepiece_codec, sharding,
    substring_dedup, suffix_array_dedup, topk_search, warc)

SHARDS = 24


def tokenizer_path() -> str:
    """The vocabulary file of the public tokenizer; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.class_ids(documents(spark, sf_dir))


def op2_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(documents(spark, sf_dir))


def op3_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id LONG, turn LONG, role STRING, text STRING")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_digests(chat_format.chat_windows(given.unionByName(own)))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(documents(spark, sf_dir), SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.expr("pmod(vec_id, 50) = 0"))


def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup.dedup_digests(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_documents(documents(spark, sf_dir), sentencepiece_codec.model_bytes(tokenizer_path()))


def op9_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), ["doc_id"])


def op11_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.run_digests(periodic_runs.find_runs(docs))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(warc.archive(table(spark, sf_dir, "pages")))


QUERIES = (
    op1_weighted_minhash, op2_suffix_automata, op3_budgeted_windows, op4_pivotal_mixing, op5_feistel_sharding, op6_pivot_table,
    op7_prefix_free_parsing, op8_sentencepiece, op9_license_windows, op10_quality_rules, op11_son_collocations, op12_periodic_runs, op13_warc)
#: SQL for the operators whose rows it can give.
SQL: dict[str, str] = {
    "op2_suffix_automata": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h,
                       unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
        first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
        hit AS (SELECT doc_id, i FROM win JOIN first USING (h) WHERE f < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
        word AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM w),
        k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY word.p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op6_pivot_table": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_son_collocations": r"""
        WITH piece AS (SELECT lang, doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (
                 SELECT coalesce(lang, 'und') AS lang, doc_id, string_split_regex(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece),
        total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
        gram AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
                 FROM w, (VALUES (1), (2), (3), (4)) s(m) WHERE len(ws) >= m),
        f AS (SELECT lang, m, phrase, count(*) AS a FROM gram GROUP BY ALL HAVING count(*) >= 30),
        cut AS (SELECT f.lang, f.m, f.phrase, f.a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
                FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1) f, (VALUES (1), (2), (3)) c(k) WHERE k < f.m),
        scored AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
                   FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored),
        inside AS (SELECT lang, a, array_to_string(ws[s:s + z - 1], ' ') AS phrase
                   FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 2), (VALUES (2), (3)) v(z), (VALUES (1), (2), (3)) u(s)
                   WHERE z < m AND s + z - 1 <= m),
        longest AS (SELECT lang, phrase, max(a) AS b FROM inside GROUP BY ALL),
        kept AS (SELECT best.* FROM best LEFT JOIN longest USING (lang, phrase) WHERE o = 1 AND (b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS o,
                          first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS last FROM pages),
        d AS (SELECT *, sha1(b) AS h FROM p)
        SELECT page_id, octet_length(b) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INT), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
               CASE WHEN o = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN o > 1 THEN last END AS refers_to FROM d""",
}


def register(registry: Registry) -> None:
    for query in QUERIES:
        registry.add(query.__name__, query, SQL.get(query.__name__))
