"""Small tables and plain Python counterparts that the tests share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def words(text):
    return WORD.findall(text or "")


def table(spark, rows, partitions=3):
    """Rows of (doc_id, text[, lang, source]) as a documents table over several partitions."""
    full = [(i, t, *(more or ("en", "s")), None if t is None else len(t)) for i, t, *more in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions)


def prose(rng, n, vocabulary=100_000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def collect(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect()) if columns else sorted(map(tuple, df.collect()))


def hard_rows(rng=None):
    """Nulls, empty texts, ties, repeated rows and a long text."""
    rng = rng or random.Random(5)
    passage, long = prose(rng, 70), prose(rng, 3000)
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (6, passage), (7, f"{prose(rng, 20)} {passage} {prose(rng, 9)}"),
        (8, passage.replace(" ", "\n")), (9, long), (10, long + " tail"), (10, "same id " + passage), (None, passage + " null id"),
        (None, None), (11, prose(rng, 49)), (12, prose(rng, 60)), (12, prose(rng, 60)), (13, "a b c " * 300), (14, "é日本 " * 200),
        (15, passage), (15, passage)]
