"""Web archives: pages as WARC records in gzip members, and a splittable reader.

An archive file is a row of gzip members with one record each, so a reader may begin at any
member. A task gets a byte range, looks for gzip magic in it, takes for a member what inflates
to a WARC header, and owns the records that start inside its range, wherever they end.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspan.operators.store import fresh, stage

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What may stand in a header's URL as it is.
URL_SAFE = "!#$%&'()*+,/:;=?@[]~-._<>\"{}|\\^`"

#: A member of nothing; its last byte is zero.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: Bytes that are read from a file at once.
CHUNK = 1 << 20
#: Bytes of a file that one task scans.
RANGE = 32 << 20


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(fields: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    member = gzip.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n", level, mtime=0)
    # A member ends in the high byte of its length, zero below 16 MB.
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def _http(n_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()


def _fields(kind: str, page: int | None, row: int, url: str | None, date: str, digest: str) -> list[tuple[str, str | None]]:
    return [
        ("WARC-Type", kind), ("WARC-Record-ID", _record_id(page, row)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else quote(url, safe=URL_SAFE)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]


def _record_id(page: int | None, row: int) -> str:
    return f"<urn:page:{'' if page is None else page}:{row}>"


def _responses(pages: DataFrame, date: str, level: int) -> DataFrame:
    """page, row, url, same, digest, n_bytes, member: each page as a response; ``same`` tells payloads apart."""
    given = pages.select(
        F.col("page_id").cast("long").alias("page"), F.monotonically_increasing_id().alias("row"), F.col("url").cast("string"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, digests, sizes, members = [], [], [], []
            for page, row, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = sha1_base32(payload)
                same.append(hashlib.sha256(payload).digest())
                digests.append(digest)
                sizes.append(len(payload))
                members.append(_member(_fields("response", page, row, url, date, digest), _http(len(payload)) + payload, level))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(same, pa.binary()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()),
                 pa.array(members, pa.binary())],
                ["page", "row", "url", "same", "digest", "n_bytes", "member"])

    return given.mapInArrow(
        run, "page LONG, row LONG, url STRING, same BINARY, digest STRING, n_bytes LONG, member BINARY")


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> None:
    """Write ``pages`` (page_id LONG, url STRING, html STRING) as WARC 1.1 files into the new ``folder``.

    Every page is one record whose payload is the html in UTF-8; null html is the empty payload,
    a null url leaves its header out, a null page_id an empty place in the record's id. Of records
    with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a
    response, the others revisit it and carry HTTP headers only; null page_ids count as smaller
    than all others, and of rows that tie any one is the response. Shorter payloads are all
    responses. Very long payloads are held one at a time. Further columns are not read; an empty
    table gives a folder without records. Each file begins with a warcinfo record.

    Members are made before anything is shuffled, so what moves is compressed. Equal payloads
    meet in a partial aggregation, and their rows in a merge join of written tables, which
    adaptive execution splits where one payload holds a large share of the pages. The files are
    committed by Spark's text writer: a member's last byte is zero, which is the line separator.
    """
    rows = stage(_responses(pages, date, level), "warc-members")
    equal = rows.filter(F.col("n_bytes") >= least_bytes).groupBy("same").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("page", "row")).alias("last")).filter("n > 1")
    equal = stage(equal.select("same", F.col("last.page").alias("last_page"), F.col("last.row").alias("last_row")), "warc-equal")
    # A revisit does not move its member.
    decided = rows.join(equal.hint("merge"), "same", "left")
    revisit = F.coalesce(F.col("last_row") != F.col("row"), F.lit(False))
    decided = decided.select(
        "page", "row", "url", "digest", "n_bytes", "last_page", "last_row", F.when(~revisit, F.col("member")).alias("member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _member(
            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:page:info>"), ("WARC-Date", date),
             ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
        for batch in batches:
            out = [info] if batch.num_rows else []
            info = b"" if out else info
            for page, row, url, digest, n_bytes, last_page, last_row, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if member is None:
                    fields = _fields("revisit", page, row, url, date, digest)
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(last_page, last_row))]
                    member = _member(fields, _http(n_bytes), level)
                out.append(member)
            # The line separator puts the last byte back.
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in out if m], pa.binary())], ["member"])

    lines = decided.mapInArrow(run, "member BINARY").select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", "\x00").option("compression", "none").text(folder)


class _Window:
    """Bytes of a file by place; ascending places read the file once."""

    def __init__(self, file):
        self.file, self.base, self.data = file, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the file's end."""
        if at < self.base or at + n > self.base + len(self.data):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(max(n, CHUNK))
        return self.data[at - self.base : at - self.base + n]

    def find(self, mark: bytes, at: int, end: int) -> int | None:
        """The first place of ``mark`` from ``at`` that begins before ``end``."""
        while at < end:
            piece = self.get(at, min(CHUNK, end - at + len(mark) - 1))
            found = piece.find(mark)
            if found >= 0:
                return at + found if at + found < end else None
            if len(piece) < len(mark):
                return None
            at += len(piece) - len(mark) + 1
        return None


def _inflated(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record in the member at ``at`` and the place behind it; None where no such member begins.

    A candidate whose flags, first inflated bytes, checksum or length are not those of a WARC
    record's member is none.
    """
    if len(head := window.get(at, 10)) < 10 or head[3] & 0xE0:
        return None
    engine, pieces, size, step, place = zlib.decompressobj(31), [], 0, 1 << 13, at
    while not engine.eof:
        chunk = window.get(place, step)
        if not chunk:
            return None
        place, step = place + len(chunk), min(2 * step, CHUNK)
        try:
            pieces.append(engine.decompress(chunk))
        except zlib.error:
            return None
        size += len(pieces[-1])
        if len(pieces) > 1 and len(pieces[0]) < 5:
            pieces = [b"".join(pieces)]
        if size >= 5 and not pieces[0].startswith(b"WARC/"):
            return None
    record = b"".join(pieces)
    return (record, place - len(engine.unused_data)) if record.startswith(b"WARC/") else None


def members(file, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """Place, end and record of the members that begin in [start, end) of a file."""
    window, at = _Window(file), start
    while (at := window.find(MAGIC, at, end)) is not None:
        found = _inflated(window, at)
        if found is None:
            at += 1
        else:
            yield at, found[1], found[0]
            at = found[1]


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse_record(record: bytes) -> dict:
    """The parts of one record under the names of ``RECORD``, without its place."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _headers(head)
    length = int(fields.get("content-length", len(rest)))
    block = rest[:length]
    if len(block) < length:
        raise ValueError(f"record {fields.get('warc-record-id')} is cut")
    kind, payload, told = fields.get("warc-type"), block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = _headers(http).get("content-length")
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        return {**_common(kind, fields), "payload": None, "payload_bytes": int(told) if told and told.isdigit() else None,
                "payload_digest": claimed, "intact": None}
    digest = sha1_base32(payload)
    return {**_common(kind, fields), "payload": payload, "payload_bytes": len(payload), "payload_digest": digest,
            "intact": None if claimed is None else claimed == digest}


def _common(kind: str | None, fields: dict[str, str]) -> dict:
    names = {"record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "date": "warc-date"}
    return {"type": kind, **{k: fields.get(v) for k, v in names.items()}}


RECORD = (
    "path STRING, offset LONG, end LONG, type STRING, record_id STRING, refers_to STRING, target_uri STRING, date STRING, "
    "payload BINARY, payload_bytes LONG, payload_digest STRING, intact BOOLEAN")


def _opened(path: str):
    """A file of any store that Arrow knows, open for reads at any place."""
    local = re.fullmatch(r"file:/*(/.*)", path)
    system, at = (fs.LocalFileSystem(), unquote(local[1])) if local else fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of all gzipped WARC files under ``folder``, one row each (``RECORD``).

    ``payload`` is what follows the HTTP headers of an HTTP record, otherwise the block; a
    revisit has none, and gives the length and digest that its headers tell. ``intact`` says
    whether the payload has the digest its record claims (null: none claimed). A member that
    is cut or damaged is not a record; a record shorter than its own length is an error. An
    empty folder gives no rows. One record is held in memory at a time, however many tasks
    share its file.

    The driver learns only how many ranges there are: files are listed by Spark and cut into
    ranges in a job of its own.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n_ranges = files.agg(F.sum(F.expr(f"(length - 1) DIV {range_bytes} + 1"))).first()[0] or 1
    names = [f.split(" ")[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in zip(names, TYPES, strict=True)])
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                with _opened(path) as file:
                    for at, end, record in members(file, start, min(start + range_bytes, length)):
                        rows.append({"path": path, "offset": at, "end": end, **parse_record(record)})
                        size += len(record)
                        if size > CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.repartition(int(n_ranges)).mapInArrow(run, RECORD)


TYPES = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.binary(), pa.int64(), pa.string(), pa.bool_()]


def page_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages among ``records``."""
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):[0-9]+>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return records.filter(F.col("type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"))


def archive(pages: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Write ``pages`` into a new archive in the shared folder and read its records back."""
    folder = fresh(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder, range_bytes)
