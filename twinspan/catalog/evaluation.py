"""Labelled pairs, metrics, thresholds and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinspan.catalog import common as B
from twinspan.functions import text as X
from twinspan.operators import evaluate as E
from twinspan.operators import labels as L

LP = f"WITH {B.SQL_LABELED}"
SC = f"WITH {B.SQL_SCORED}"
RANK = "CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 3 END"
METRICS = """
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc"""
WILSON = """CASE WHEN tp + fp = 0 THEN 0.0 ELSE
   (p + 1.96 * 1.96 / (2 * (tp + fp)) - 1.96 * sqrt(p * (1 - p) / (tp + fp) + 1.96 * 1.96 / (4.0 * (tp + fp) * (tp + fp))))
   / (1 + 1.96 * 1.96 / (tp + fp)) END"""


def functions(spark, sf):
    """Conversation turns as functions, with a split from the conversation."""
    c = B.table(spark, sf, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (F.col("conv_id") % 3 + 1).cast("int")).alias("split"),
        F.concat("role", (F.length("text") % 40).cast("string")).alias("fp"))


SQL_FUNCTIONS = """
fn AS (SELECT conv_id || '-' || turn AS id, (['train', 'valid', 'test'])[conv_id % 3 + 1] AS split, role || (length(text) % 40) AS fp FROM conversations)
"""


def noisy_pairs(spark, sf):
    """Order pairs whose small key space repeats unordered pairs with other labels."""
    li = B.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    return li.select(
        F.when(F.col("l_orderkey") % 10 < 6, "train").when(F.col("l_orderkey") % 10 < 8, "valid").otherwise("test").alias("split"),
        (F.col("p") % 60).alias("a_id"), (F.col("s") % 60).alias("b_id"),
        (F.col("l_orderkey") % 2).cast("int").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))


SQL_NOISY = """
np AS (SELECT CASE WHEN l_orderkey % 10 < 6 THEN 'train' WHEN l_orderkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split,
              min(l_partkey) % 60 AS a_id, min(l_suppkey) % 60 AS b_id, CAST(l_orderkey % 2 AS INTEGER) AS label, l_orderkey * 10 + l_linenumber AS ordinal
       FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""


def raw_labeled(spark, sf):
    """Conversation turn pairs as labelled code, some of them faulty."""
    c = B.table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("code_a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.when(F.col("conv_id") % 11 == 0, F.lit("  ")).when(F.col("conv_id") % 13 == 0, F.lit("a b")).otherwise(F.col("text")).alias("code_b"))
    j = a.join(b, ["conv_id", "turn"])
    return j.select(
        "conv_id", "turn", "code_a", F.when(F.col("conv_id") % 7 == 0, F.col("code_a")).otherwise(F.col("code_b")).alias("code_b"),
        F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test"), F.lit("dev")), (F.col("turn") % 4 + 1).cast("int")).alias("split"),
        (F.col("turn") % 5 % 3).cast("int").alias("label"))


def metrics_view(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "precision_wilson_lower_95")})


def register(r: B.Registry) -> None:
    from twinspan import constants as C

    tk = lambda c: f"list_filter(regexp_extract_all({c}, {B.pattern(C.TOKEN_PATTERN_PLAIN)}), lambda t: NOT starts_with(t, '//') AND NOT starts_with(t, '/*'))"
    raw = """rl0 AS (SELECT a.conv_id, a.turn, a.text AS code_a, CASE WHEN a.conv_id % 11 = 0 THEN '  ' WHEN a.conv_id % 13 = 0 THEN 'a b' ELSE b.text END AS cb
                FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
        rl AS (SELECT conv_id, turn, code_a, CASE WHEN conv_id % 7 = 0 THEN code_a ELSE cb END AS code_b,
                      (['train', 'valid', 'test', 'dev'])[turn % 4 + 1] AS split, turn % 5 % 3 AS label FROM rl0)"""

    def validated(spark, sf):
        good, bad = L.validate_labeled(raw_labeled(spark, sf))
        return good.select("conv_id", "turn", F.lit("").alias("reasons")).unionByName(
            bad.select("conv_id", "turn", F.array_join("reasons", "; ").alias("reasons")))

    r.add("validate_labeled", validated, f"""WITH {raw}, k AS (SELECT *, {tk('code_a')} AS ta, {tk('code_b')} AS tb FROM rl)
        SELECT conv_id, turn, array_to_string(list_filter([
            CASE WHEN split = 'dev' OR label NOT IN (0, 1) THEN 'invalid split or label' END,
            CASE WHEN regexp_matches(code_a, '^\\s*$') OR regexp_matches(code_b, '^\\s*$') THEN 'empty code' END,
            CASE WHEN len(ta) < 3 OR len(tb) < 3 THEN 'fewer than three tokens' END,
            CASE WHEN ta = tb AND label = 0 THEN 'identical snippets labelled 0' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM k""")

    r.add("all_ids", lambda spark, sf: L.all_ids(B.labeled_pairs(spark, sf)), f"{LP} SELECT a_id AS id FROM lpairs UNION SELECT b_id FROM lpairs")

    def strangers(spark, sf):
        fn = B.table(spark, sf, "documents").filter("n_chars >= 900").select(F.col("doc_id").alias("id"))
        return L.unknown_ids(B.labeled_pairs(spark, sf), fn)

    r.add("unknown_ids", strangers, f"{LP} SELECT id FROM (SELECT a_id AS id FROM lpairs UNION SELECT b_id FROM lpairs) WHERE id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 900)")

    r.add("split_audit", lambda spark, sf: L.split_audit(noisy_pairs(spark, sf)), f"""WITH {SQL_NOISY},
        i AS (SELECT split, a_id AS id FROM np UNION ALL SELECT split, b_id FROM np),
        k AS (SELECT split, count(*) AS function_references, count(DISTINCT id) AS functions FROM i GROUP BY split)
        SELECT split, count(*) AS pairs, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative,
               any_value(function_references) AS function_references, any_value(functions) AS functions,
               count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0 AS both_labels FROM np JOIN k USING (split) GROUP BY split""")
    r.add("missing_labels", lambda spark, sf: L.missing_labels(noisy_pairs(spark, sf), (0, 1, 2)).select("split", F.array_join("missing", ",").alias("missing")),
          f"WITH {SQL_NOISY} SELECT split, '2' AS missing FROM np GROUP BY split")
    r.add("leakage", lambda spark, sf: L.leakage(functions(spark, sf), "fp").select("fp", F.size("splits").alias("n")),
          f"WITH {SQL_FUNCTIONS} SELECT fp, CAST(count(DISTINCT split) AS INTEGER) AS n FROM fn GROUP BY fp HAVING count(DISTINCT split) > 1")
    r.add("shared_ids", lambda spark, sf: L.shared_ids(functions(spark, sf), "train", "test", "fp"),
          f"WITH {SQL_FUNCTIONS} SELECT fp FROM fn WHERE split = 'train' INTERSECT SELECT fp FROM fn WHERE split = 'test'")
    r.add("contradictory_pairs", lambda spark, sf: L.contradictory_pairs(noisy_pairs(spark, sf)),
          f"WITH {SQL_NOISY} SELECT least(a_id, b_id) AS lo, greatest(a_id, b_id) AS hi, count(*) AS n FROM np GROUP BY lo, hi HAVING count(DISTINCT label) > 1")
    r.add("contradictory_within_split", lambda spark, sf: L.contradictory_pairs(noisy_pairs(spark, sf), False),
          f"WITH {SQL_NOISY} SELECT split, least(a_id, b_id) AS lo, greatest(a_id, b_id) AS hi, count(*) AS n FROM np GROUP BY split, lo, hi HAVING count(DISTINCT label) > 1")
    for keep, way in (("first", "ASC"), ("last", "DESC")):
        r.add(f"dedupe_pairs_{keep}", lambda spark, sf, k=keep: L.dedupe_pairs(noisy_pairs(spark, sf), k),
              f"""WITH {SQL_NOISY}, o AS (SELECT *, row_number() OVER (PARTITION BY split, least(a_id, b_id), greatest(a_id, b_id) ORDER BY ordinal {way}) AS k FROM np)
                  SELECT split, a_id, b_id, label, ordinal FROM o WHERE k = 1""")
    r.add("first_owner", lambda spark, sf: L.first_owner(functions(spark, sf)).select("id", "split", "kept"),
          f"""WITH {SQL_FUNCTIONS} SELECT id, split, {RANK} = min({RANK}) OVER (PARTITION BY fp) AS kept FROM fn""")
    r.add("sample_functions", lambda spark, sf: L.sample_functions(functions(spark, sf).select("split", "id"), {"train": 50, "valid": 20, "test": 0}, 42),
          f"""WITH {SQL_FUNCTIONS}, o AS (SELECT DISTINCT split, id, md5('42:' || id) AS d FROM fn),
              k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY d, id) AS n FROM o)
              SELECT split, id FROM k WHERE n <= CASE split WHEN 'train' THEN 50 WHEN 'valid' THEN 20 ELSE 1000000000000 END""")

    def induced(spark, sf):
        p = noisy_pairs(spark, sf)
        selected = p.filter("label = 1").select("split", F.col("a_id").alias("id")).distinct()
        eligible = p.filter("label = 0").select(F.col("b_id").alias("id")).distinct()
        return L.induced_pairs(p, selected, eligible)

    r.add("induced_pairs", induced, f"""WITH {SQL_NOISY},
        k AS (SELECT DISTINCT split, a_id AS id FROM np WHERE label = 1 AND a_id IN (SELECT b_id FROM np WHERE label = 0)),
        q AS (SELECT np.* FROM np JOIN k x ON x.split = np.split AND x.id = a_id JOIN k y ON y.split = np.split AND y.id = b_id WHERE a_id <> b_id),
        o AS (SELECT *, row_number() OVER (PARTITION BY split, least(a_id, b_id), greatest(a_id, b_id) ORDER BY ordinal DESC) AS k FROM q)
        SELECT split, a_id, b_id, label, ordinal FROM o WHERE k = 1""")
    r.add("selected_and_eligible", lambda spark, sf: functions(spark, sf).filter("split = 'train'").select("fp").intersect(
        functions(spark, sf).filter("length(id) > 3").select("fp")),
        f"WITH {SQL_FUNCTIONS} SELECT fp FROM fn WHERE split = 'train' INTERSECT SELECT fp FROM fn WHERE length(id) > 3")
    r.add("label_join", lambda spark, sf: L.label_join(B.table(spark, sf, "documents").select("doc_id", "lang"), B.table(spark, sf, "labels"), "doc_id"),
          "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
    r.add("distinct_values", lambda spark, sf: L.distinct_values(B.table(spark, sf, "documents"), "lang", "source"), "SELECT DISTINCT lang, source FROM documents")

    # --- metrics
    conf = f"""{SC}, c AS (SELECT lang, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
        count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM scored GROUP BY lang),
        m AS (SELECT *, {METRICS} FROM c)"""
    shown = f"""lang, tp, fp, fn, tn, round(p, 6) AS precision, round(rc, 6) AS recall,
        round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 6) AS f1, round({WILSON}, 6) AS precision_wilson_lower_95, tp + fp + fn + tn AS examples"""
    r.add("confusion_metrics", lambda spark, sf: metrics_view(E.confusion_metrics(B.scored(spark, sf), 0.5, "lang")), f"{conf} SELECT {shown} FROM m")

    sweep = f"""{SC}, g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY score),
        s AS (SELECT score, CAST(sum(n) OVER o AS BIGINT) AS predicted, CAST(sum(pos) OVER o AS BIGINT) AS tp, CAST(sum(pos) OVER () AS BIGINT) AS allpos
              FROM g WINDOW o AS (ORDER BY score DESC)),
        w AS (SELECT score, predicted, tp, tp / predicted AS precision, tp / greatest(allpos, 1) AS recall FROM s)"""
    r.add("threshold_sweep", lambda spark, sf: E.threshold_sweep(B.scored(spark, sf)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")}),
          f"{sweep} SELECT score, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM w")
    r.add("select_threshold", lambda spark, sf: E.select_threshold(B.scored(spark, sf), 0.86, 0.1).withColumns({c: F.round(c, 6) for c in ("precision", "recall")}),
          f"""{sweep} SELECT b.score AS threshold, round(b.precision, 6) AS precision, round(b.recall, 6) AS recall FROM
              (SELECT max({{'recall': recall, 'precision': precision, 'score': score}}) FILTER (score > 0 AND precision >= 0.86 AND recall >= 0.1) AS b FROM w)""")

    def at_threshold(spark, sf):
        return metrics_view(E.at_selected_threshold(B.scored(spark, sf), 2.0, 0.1)).select("threshold", "tp", "fp", "fn", "tn", "recall")

    r.add("no_threshold_selected", at_threshold, f"""{SC} SELECT CAST(NULL AS DOUBLE) AS threshold, 0 AS tp, 0 AS fp, count(*) FILTER (label = 1) AS fn,
        count(*) FILTER (label = 0) AS tn, 0.0 AS recall FROM scored""")

    def epochs(spark, sf):
        e = B.table(spark, sf, "events")
        h = e.select("user_id", F.col("event_id").alias("epoch"), F.when(F.col("event_id") % 3 > 0, F.floor("value") / 10).alias("threshold"),
                     (F.floor(F.col("value")) % 5 / 5).alias("recall"), (F.col("event_id") % 4 / 4).alias("precision"), (F.col("event_id") % 2 / 2).alias("fallback_f1"))
        return E.best_epoch(h, "user_id").select("user_id", "epoch", "recall", "precision")

    r.add("best_epoch", epochs, """WITH h AS (SELECT user_id, event_id AS epoch, event_id % 3 > 0 AS has, floor(value) % 5 / 5 AS recall, event_id % 4 / 4 AS precision, event_id % 2 / 2 AS f FROM events),
        o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY has DESC, recall DESC, precision DESC, f DESC, epoch) AS k FROM h)
        SELECT user_id, epoch, recall, precision FROM o WHERE k = 1""")

    def gate(spark, sf):
        m = E.confusion_metrics(B.scored(spark, sf), 0.5, "lang").withColumnRenamed("lang", "name")
        return E.serving_gate(m, 0.8, 0.5).select("name", F.array_join("reasons", "; ").alias("reasons"), "eligible")

    r.add("serving_gate", gate, f"""{conf}, x AS (SELECT lang AS name, array_to_string(list_filter([
            CASE WHEN tp + fn < 100 OR tn + fp < 100 THEN lang || ': fewer than 100 examples of each class' END,
            CASE WHEN {WILSON} < 0.8 THEN lang || ': precision confidence bound below target' END,
            CASE WHEN rc < 0.5 THEN lang || ': recall below target' END], lambda v: v IS NOT NULL), '; ') AS reasons FROM m)
        SELECT name, reasons, reasons = '' AS eligible FROM x""")

    def models(spark, sf):
        s = B.table(spark, sf, "supplier")
        k = F.col("s_suppkey")
        pairs = F.when(k % 4 == 0, F.array(F.lit("c:c"))).when(k % 4 == 1, F.array(F.lit("java:java"), F.lit("go:go"))).when(
            k % 4 == 2, F.array(F.lit("java:python"))).otherwise(F.array().cast("array<string>"))
        meta = s.select("s_suppkey", F.lit(C.HEAD_FORMAT).alias("format"), F.lit(C.HEAD_ENCODER).alias("encoder"),
                        (k % 3 > 0).alias("eligible_for_serving"), (k % 6 / 4).alias("threshold"), pairs.alias("validated_language_pairs"))
        return E.eligible_models(meta).select("s_suppkey", "threshold")

    r.add("eligible_models", models, """SELECT s_suppkey, s_suppkey % 6 / 4 AS threshold FROM supplier
        WHERE s_suppkey % 3 > 0 AND s_suppkey % 6 BETWEEN 1 AND 4 AND s_suppkey % 4 IN (0, 2)""")

    fp = f"WITH {B.SQL_FILE_PAIRS}"

    def taxonomy(spark, sf):
        p = B.file_pairs(spark, sf)
        return p.select("id_a", "id_b", E.rule_classify(
            "similarity", F.col("n_sum") % 100 / 100, F.col("n_sum") % 37 / 37, F.col("n_sum") % 2, F.lit(0), "cross_language",
            F.when(F.col("n_sum") % 3 == 0, 0.0).otherwise(0.4)).alias("clone_type"))

    r.add("rule_classify", taxonomy, f"""{fp}, v AS (SELECT *, similarity AS s, n_sum % 100 / 100 AS t, n_sum % 37 / 37 AS q, CASE WHEN n_sum % 3 = 0 THEN 0.5 ELSE 0.4 END AS lim FROM pairs)
        SELECT id_a, id_b, CASE WHEN s < lim THEN NULL WHEN cross_language THEN 'Type-4' WHEN t >= 0.95 THEN 'Type-1'
            WHEN n_sum % 2 = 0 AND (t >= 0.6 OR q >= 0.85) AND s >= 0.75 THEN 'Type-2'
            WHEN (t >= 0.3 OR q >= 0.55) AND s >= 0.65 THEN 'Type-3' ELSE 'Type-4' END AS clone_type FROM v""")

    r.add("type_or_null", lambda spark, sf: B.file_pairs(spark, sf).select("id_a", "id_b", E.type_or_null(
        ~F.col("cross_language"), F.col("n_sum") % 5 == 0, F.col("n_sum") % 3 == 0, "similarity", F.lit(0.5)).alias("clone_type")),
        f"""{fp} SELECT id_a, id_b, CASE WHEN cross_language THEN NULL WHEN n_sum % 5 = 0 THEN 'Type-1' WHEN n_sum % 3 = 0 THEN 'Type-2'
            WHEN similarity >= 0.75 THEN 'Type-3' END AS clone_type FROM pairs""")

    def compared(spark, sf):
        p = B.file_pairs(spark, sf)
        actual = p.filter("similarity >= 0.3").select(F.col("id_b").alias("region_a"), F.col("id_a").alias("region_b"), "clone_type")
        expected = p.filter("similarity <= 0.8").select(
            F.col("id_a").alias("region_a"), F.col("id_b").alias("region_b"), F.concat(F.lit("Type-"), (1 + F.col("n_sum") % 2).cast("string")).alias("clone_type"))
        return E.compare_expected(actual, expected)

    r.add("compare_expected", compared, f"""{fp}, v AS (SELECT id_a AS lo, id_b AS hi, CASE WHEN similarity >= 0.3 THEN clone_type END AS actual,
            CASE WHEN similarity <= 0.8 THEN 'Type-' || (1 + n_sum % 2) END AS expected FROM pairs)
        SELECT lo, hi, actual, expected, CASE WHEN expected IS NULL THEN 'extra' WHEN actual IS NULL THEN 'missing'
            WHEN actual = expected THEN 'match' ELSE 'wrong type' END AS verdict FROM v WHERE actual IS NOT NULL OR expected IS NOT NULL""")

    def regression(spark, sf):
        p = B.file_pairs(spark, sf)
        cases = p.select("job_id", "id_a", "id_b", (F.col("n_sum") % 11 == 0).alias("same_tokens"), (F.col("n_sum") % 7 == 0).alias("same_params"),
                         F.col("similarity").alias("raw_ratio"), (F.col("n_sum") % 90 / 100).alias("param_ratio"), (F.col("n_sum") % 97 / 100).alias("cosine"),
                         F.when(F.col("n_sum") % 4 > 0, F.col("clone_type")).alias("expected"), F.when(F.col("n_sum") % 6 > 0, F.col("clone_type")).alias("current"))
        return E.regression_report(cases)

    reg = f"""{fp}, g AS (SELECT job_id, id_a, id_b, CASE WHEN n_sum % 11 = 0 THEN 'Type-1' WHEN n_sum % 7 = 0 THEN 'Type-2'
            WHEN greatest(similarity, n_sum % 90 / 100) >= 0.75 THEN 'Type-3' WHEN n_sum % 97 / 100 >= 0.85 THEN 'Type-4' END AS previous,
            CASE WHEN n_sum % 4 > 0 THEN clone_type END AS expected, CASE WHEN n_sum % 6 > 0 THEN clone_type END AS current FROM pairs)"""
    r.add("regression_report", lambda spark, sf: regression(spark, sf).select("id_a", "id_b", "previous", "expected", "current", "agrees"),
          f"{reg} SELECT id_a, id_b, previous, expected, current, current IS NOT DISTINCT FROM expected AS agrees FROM g")
    r.add("exact_label_accuracy", lambda spark, sf: E.exact_label_accuracy(regression(spark, sf), "job_id"),
          f"""{reg} SELECT job_id, count(*) AS cases, count(*) FILTER (previous IS NOT DISTINCT FROM expected) AS previous_exact,
              count(*) FILTER (current IS NOT DISTINCT FROM expected) AS current_exact FROM g GROUP BY job_id""")

    # --- training: no SQL form
    def trained(spark, sf):
        from twinspan.catalog.semantics import embeddings
        from twinspan.operators.learning import fit_pair_classifier

        emb = embeddings(spark, sf)
        p = B.pair_up(emb.select("id", "label"), "id", "label")
        k = F.col("id_a") % 10
        pairs = p.select(
            F.when(k < 6, "train").when(k < 8, "valid").otherwise("test").alias("split"),
            F.col("id_a").alias("a_id"), F.col("id_b").alias("b_id"), (F.col("label_a") == F.col("label_b")).cast("int").alias("label"))
        return fit_pair_classifier(pairs, emb.select("id", "vector"), 64, 0.3, 0.1).gate

    r.add("fit_pair_classifier", trained)
