"""Web archives: what is written is read back, wherever a file is cut."""

import gzip
import io
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from twinspan.llm import queries, warc
from twinspan.operators.store import fresh

PAGES = "page_id LONG, url STRING, html STRING"


def expected(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, pages in groups.items():
        pages.sort(key=lambda p: (p is not None, p), reverse=True)
        for k, page in enumerate(pages):
            out.append((page, len(payload), warc.sha1_base32(payload), "revisit" if k else "response", pages[0] if k else None))
    return sorted(out, key=repr)


def given(spark, rows, partitions=3):
    return spark.createDataFrame(rows, PAGES).repartition(partitions)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


HARD = [
    (1, "http://a/b?c=%20d", "dup"), (3, "u\r\nWARC-Type: evil", "dup"), (2, None, "dup"), (3, "u", "dup"), (None, "z", "dup"),
    (10, "a", None), (11, "a", ""), (None, None, None), (12, "é 日本", "<p>é日本</p>" * 3), (13, "x", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"),
    (14, "y", "\r\n\r\n"), (-5, "n", "\x1f\x00 control"), (20, "same", "row"), (20, "same", "row")]


@pytest.mark.parametrize("range_bytes", [1, 37, 500, 1 << 20])
def test_hard_pages_with_ranges_of_any_size(spark, range_bytes):
    pages = given(spark, HARD).withColumn("row", F.lit("own")).withColumn("member", F.lit(1)).withColumn("same", F.lit(2))
    assert got(warc.page_digests(warc.archive(pages, range_bytes))) == expected(HARD)


def test_the_smallest_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(queries.op13_warc(spark, SMALL)) == expected(rows)


def test_an_empty_table(spark):
    assert warc.archive(given(spark, [])).count() == 0


def test_records_chain_without_gaps_and_hold_the_texts(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abc <>é") for _ in range(rng.randrange(3000)))) for i in range(120)]
    folder = fresh(spark, "warc")
    warc.write_warc(given(spark, rows, 4), folder)
    records = warc.read_warc(spark, folder, 700).collect()
    ends = defaultdict(list)
    for r in records:
        ends[r.path].append((r.offset, r.end))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    pages = [r for r in records if r.type == "response"]
    assert sorted((r.target_uri, bytes(r.payload).decode()) for r in pages) == sorted((u, t) for _, u, t in rows)
    assert all(r.intact for r in pages) and len({r.record_id for r in pages}) == len(rows)
    # Any gzip reader reads the whole file.
    for path, spans in ends.items():
        with open(path.removeprefix("file:"), "rb") as f:
            data = f.read()
        whole = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
        assert whole.count(b"WARC-Record-ID") == len(spans)


def test_payloads_under_the_least_size_are_all_responses(spark):
    folder = fresh(spark, "warc")
    warc.write_warc(given(spark, HARD), folder, least_bytes=4)
    kinds = {(r.page_id, r.record_type) for r in warc.page_digests(warc.read_warc(spark, folder)).collect()}
    assert (1, "response") in kinds and not any(k == "revisit" for _, k in kinds)


def test_a_very_long_payload_ends_in_an_empty_member(spark):
    rows = [(1, "u", "x" * 17_000_000 + "é"), (2, "u", "y")]
    assert got(warc.page_digests(warc.archive(given(spark, rows, 1), 1 << 12))) == expected(rows)


def test_magic_that_begins_no_record_is_passed_over():
    record = warc._member([("WARC-Type", "resource")], b"z" * 50, 6)
    other = gzip.compress(b"not a record", mtime=0)
    data = warc.MAGIC + b"\x00" * 20 + other + record + warc.MAGIC + record[:30] + record
    found = [(a, b) for a, b, _ in warc.members(io.BytesIO(data), 0, len(data))]
    first = 23 + len(other)
    assert found == [(first, first + len(record)), (len(data) - len(record), len(data))]


def test_a_cut_record_is_an_error_and_a_wrong_digest_is_told():
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    told = warc.parse_record(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert told["intact"] is False and told["payload"] == b"abc"


def test_a_third_of_all_pages_with_one_payload(spark):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"p{i}") for i in range(900)]
    assert got(warc.page_digests(warc.archive(given(spark, rows, 8)))) == expected(rows)
