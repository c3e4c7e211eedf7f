"""Lines, spans, windows and fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinspan.catalog import common as B
from twinspan.functions import text as X
from twinspan.operators import segment as G

FR = B.sql_fragments()
T = B.sql_tokens()
HEAD = r"^\s*([A-Z]\p{L}*)"

# Indented text derived from the documents: a line's length sets its depth.
SQL_INDENTED = """
src AS (SELECT source || '/' || doc_id || '.txt' AS file, string_split(text, chr(10)) AS l0 FROM documents),
src1 AS (SELECT file, CASE WHEN l0[-1] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS l FROM src),
raw_lines AS (SELECT file, unnest(l) AS t0, generate_subscripts(l, 1) AS n FROM src1),
lines AS (SELECT file, n, repeat('  ', CAST(length(t0) % 4 AS INTEGER)) || t0 AS text FROM raw_lines)
"""


def lines(spark, sf):
    return G.split_lines(B.files(spark, sf))


def indented(spark, sf):
    return lines(spark, sf).withColumn("text", F.concat(F.repeat(F.lit("  "), F.length("text") % 4), "text"))


def spans(spark, sf):
    """One or two spans per document that has lines enough for them."""
    f = B.files(spark, sf).select("job_id", "file", F.size(X.split_lines("content")).alias("k"))
    one = f.filter("k >= 3").select("job_id", "file", F.lit(2).alias("start_line"), (F.col("k") / 2 + 1).cast("int").alias("end_line"), F.lit("one").alias("name"))
    two = f.filter("k >= 8").select("job_id", "file", F.lit(3).alias("start_line"), F.lit(4).alias("end_line"), F.lit("two").alias("name"))
    return one.unionByName(two).unionByName(two.withColumn("name", F.lit("zwei")))


SQL_SPANS = """
sizes AS (SELECT file, l, len(l) AS k FROM (SELECT source || '/' || doc_id || '.txt' AS file,
            CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[1:len(string_split(text, chr(10))) - 1]
                 ELSE string_split(text, chr(10)) END AS l FROM documents)),
spans AS (
  SELECT file, 2 AS start_line, CAST(floor(k / 2 + 1) AS INTEGER) AS end_line, 'one' AS name FROM sizes WHERE k >= 3
  UNION ALL SELECT file, 3, 4, 'two' FROM sizes WHERE k >= 8)
"""


def register(r: B.Registry) -> None:
    r.add("split_lines", lambda spark, sf: lines(spark, sf).select("file", "n", F.length("text").alias("width")),
          f"WITH {SQL_INDENTED} SELECT file, n, length(t0) AS width FROM raw_lines")

    r.add("fragments", lambda spark, sf: G.fragments(B.files(spark, sf)).select(
        "frag_id", "start_line", "end_line", F.md5(F.col("code").cast("binary")).alias("digest")),
        f"WITH {FR} SELECT frag_id, start_line, end_line, md5(code) AS digest FROM frag")

    r.add("sliding_windows", lambda spark, sf: G.fragments(B.files(spark, sf)).groupBy("file").agg(
        F.count("*").alias("windows"), F.max("end_line").alias("last_line")),
        f"WITH {FR} SELECT file, count(*) AS windows, max(end_line) AS last_line FROM frag GROUP BY file")

    r.add("attach_spans", lambda spark, sf: G.attach_spans(B.files(spark, sf), G.dedupe_spans(spans(spark, sf))).select(
        "file", "start_line", "end_line", "name", F.md5(F.col("code").cast("binary")).alias("digest")),
        f"""WITH {SQL_SPANS} SELECT file, start_line, end_line, name,
            md5(array_to_string(l[start_line:end_line], chr(10))) AS digest FROM spans JOIN sizes USING (file)""")

    r.add("dedupe_spans", lambda spark, sf: G.dedupe_spans(spans(spark, sf)).select("file", "start_line", "end_line", "name"),
          f"WITH {SQL_SPANS} SELECT file, start_line, end_line, name FROM spans")

    r.add("uncovered_blocks", lambda spark, sf: G.uncovered_blocks(B.files(spark, sf), G.dedupe_spans(spans(spark, sf))).select(
        "file", "start_line", "end_line"),
        f"""WITH {SQL_SPANS},
            ln AS (SELECT file, unnest(l) AS t, generate_subscripts(l, 1) AS n FROM sizes),
            un AS (SELECT * FROM ln WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.file = ln.file AND n BETWEEN start_line AND end_line)),
            isl AS (SELECT *, n - row_number() OVER (PARTITION BY file ORDER BY n) AS g FROM un)
            SELECT file, min(n) AS start_line, max(n) AS end_line FROM isl GROUP BY file, g
            HAVING bool_or(regexp_matches(t, '\\S'))""")

    r.add("fragments_with_spans", lambda spark, sf: G.fragments(B.files(spark, sf), spans(spark, sf)).groupBy("file").agg(
        F.count("*").alias("n"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("bigint").alias("lines")),
        f"""WITH {SQL_SPANS},
            ln AS (SELECT file, unnest(l) AS t, generate_subscripts(l, 1) AS n FROM sizes),
            un AS (SELECT * FROM ln WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.file = ln.file AND n BETWEEN start_line AND end_line)),
            isl AS (SELECT *, n - row_number() OVER (PARTITION BY file ORDER BY n) AS g FROM un),
            units AS (SELECT file, min(n) AS s, max(n) AS e FROM isl GROUP BY file, g HAVING bool_or(regexp_matches(t, '\\S'))
                      UNION ALL SELECT file, start_line, end_line FROM spans),
            tidy AS (SELECT file, s, CASE WHEN l[e] = '' THEN e - 1 ELSE e END AS e FROM units JOIN sizes USING (file)),
            win AS (SELECT file, s + o AS a, least(s + o + 79, e) AS b FROM
                    (SELECT *, unnest(range(0, CAST(ceil(greatest(e - s + 1 - 80, 0) / 60.0) * 60 AS BIGINT) + 1, 60)) AS o FROM tidy WHERE e >= s))
            SELECT file, count(*) AS n, CAST(sum(b - a + 1) AS BIGINT) AS lines FROM (SELECT DISTINCT * FROM win) GROUP BY file""")

    r.add("indent_blocks", lambda spark, sf: G.indent_blocks(indented(spark, sf), HEAD).select("file", "start_line", "end_line", "name"),
          f"""WITH {SQL_INDENTED},
              nb AS (SELECT file, n, text, length(regexp_extract(text, '^( *)', 1)) AS ind,
                            regexp_matches(text, '{HEAD}') AS head, regexp_matches(text, '^\\s*[)\\]}}]') AS closes
                     FROM lines WHERE regexp_matches(text, '\\S')),
              hd AS (SELECT * FROM nb WHERE head),
              nxt AS (SELECT h.file, h.n, h.text, min(c.n) AS stop FROM hd h LEFT JOIN nb c
                        ON c.file = h.file AND c.n > h.n AND c.ind <= h.ind AND (NOT c.closes OR c.head) GROUP BY ALL)
              SELECT x.file, x.n AS start_line, max(b.n) AS end_line, regexp_extract(x.text, '{HEAD}', 1) AS name
              FROM nxt x JOIN nb b ON b.file = x.file AND b.n >= x.n AND (x.stop IS NULL OR b.n < x.stop)
              GROUP BY x.file, x.n, x.text""")

    # Braces derived from the documents: long lines open a block, every short one closes.
    def braced(spark, sf):
        n = F.length("text")
        mark = F.when(n % 3 == 0, F.concat(F.lit("name("), n.cast("string"), F.lit(") {"))).when(n % 3 == 1, F.lit("}")).otherwise(F.lit("x;"))
        return lines(spark, sf).withColumn("text", mark)

    braces = f"""WITH {SQL_INDENTED},
        br AS (SELECT file, n, length(t0) % 3 AS m, CASE length(t0) % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS d FROM raw_lines),
        dp AS (SELECT *, CAST(sum(d) OVER (PARTITION BY file ORDER BY n) AS BIGINT) AS depth_after FROM br)"""
    r.add("brace_depth", lambda spark, sf: G.brace_depth(braced(spark, sf)).select("file", "n", "depth_before", "depth_after"),
          braces + " SELECT file, n, depth_after - d AS depth_before, depth_after FROM dp")
    r.add("brace_blocks", lambda spark, sf: G.brace_blocks(braced(spark, sf)).select("file", "start_line", "end_line"),
          braces + """ SELECT h.file, h.n AS start_line, min(c.n) AS end_line FROM dp h JOIN dp c
              ON c.file = h.file AND c.n > h.n AND c.depth_after <= h.depth_after - h.d WHERE h.m = 0 GROUP BY h.file, h.n""")

    r.add("mask_code", lambda spark, sf: B.table(spark, sf, "pages").select(
        "page_id", F.length(G.mask_code("html")).alias("width"), F.length(F.translate(G.mask_code("html"), " ", "")).alias("visible")),
        f"""WITH s AS (SELECT page_id, html, list_transform(regexp_extract_all(html, {B.pattern(B.C.CODE_SEGMENT_PATTERN_PLAIN)}),
              lambda p: CASE WHEN starts_with(p, '//') OR starts_with(p, '/*') OR (length(p) > 1 AND left(p, 1) IN ('''', '"') AND substr(p, 2, 1) <> chr(10))
                             THEN regexp_replace(p, '[^\\n]', ' ', 'g') ELSE p END) AS parts FROM pages)
            SELECT page_id, length(array_to_string(parts, '')) AS width,
                   length(replace(array_to_string(parts, ''), ' ', '')) AS visible FROM s""")

    r.add("usable_fragments", lambda spark, sf: G.usable_fragments(B.tokenised(spark, sf)).select("frag_id"),
          f"WITH {T} SELECT frag_id FROM usable")
    r.add("fragment_totals", lambda spark, sf: G.fragment_totals(B.tokenised(spark, sf, True)),
          f"WITH {B.sql_tokens('source')} SELECT t.job_id, count(*) AS fragments, count(u.frag_id) AS usable FROM tok t LEFT JOIN usable u USING (frag_id) GROUP BY t.job_id")
    r.add("fragment_guard", lambda spark, sf: G.fragment_guard(B.tokenised(spark, sf, True), 10**12).groupBy("job_id").agg(F.count("*").alias("n")),
          f"WITH {B.sql_tokens('source')} SELECT job_id, count(*) AS n FROM tok GROUP BY job_id")

    def excluded(spark, sf):
        ok, out = G.split_encodable(B.tokenised(spark, sf), 400, 8000)
        return out.select("frag_id", "reason").unionByName(ok.select("frag_id", F.lit("usable").alias("reason")))

    r.add("split_encodable", excluded, f"""WITH {T} SELECT frag_id, CASE WHEN length(code) < 1 THEN 'empty code'
        WHEN length(code) > 8000 THEN 'more than 8000 characters' WHEN len(tokens) > 400 THEN 'more than 400 tokens' ELSE 'usable' END AS reason FROM tok""")

    def marked(spark, sf):
        regions = spans(spark, sf).select("job_id", "file", "start_line", "end_line")
        return G.mark_clone_lines(lines(spark, sf), regions).select("file", "n", "in_clone")

    r.add("mark_clone_lines", marked, f"""WITH {SQL_SPANS}, ln AS (SELECT file, unnest(range(1, len(l) + 1)) AS n FROM sizes)
        SELECT ln.file, n, coalesce(bool_or(n BETWEEN start_line AND end_line), false) AS in_clone
        FROM ln LEFT JOIN spans USING (file) GROUP BY ln.file, n""")

    r.add("order_fragments", lambda spark, sf: G.fragments(B.files(spark, sf)).orderBy("file_ord", "start_line", "end_line").select("frag_id", "start_line"),
          f"WITH {FR} SELECT frag_id, start_line FROM frag ORDER BY file_ord, start_line, end_line")
