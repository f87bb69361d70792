"""WARC archives: written by Spark's text sink, read back, continued records put together.

A page becomes one record: a response with its HTTP message, or a revisit that names the
response with the same payload. The body of a response is framed in HTTP chunks, and a
block that is longer than ``segment_bytes`` goes on in continuation records, so a record
and, with ``archive_bytes``, a file have a bounded size. Each task rolls its own archives.

Reading parses each archive by the length that its records tell, groups continuations by
the id of the record that they continue, orders them by segment number, verifies that none
is missing and that the total length is as told, and then takes the chunks off.

Defined results: a null payload is an empty one; a null id is written as such and comes
back null; a null or blank url leaves the record without a target. Rows that repeat the id
and the payload of a response are responses, too, and come back as often. Of equal payloads
under ``least`` bytes each is a response. Null ids take no precedence, a group without any
other has only responses. An empty table makes no archive and reads as no rows; further
columns are not written. A broken archive, record, frame or digest is a row with its
``problem`` and no payload; reading goes on with the next archive.

The pages move once, dealt by digest; a digest's copies are a join key that adaptive
execution splits. Only records in segments move when they are read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import Scratch, mapped, utf8

_END = b"\r\n"
_ID = "urn:page:"
_NO_ID = "null"
_DATE = "2000-01-01T00:00:00Z"  # of capture, where the table has none
_CHUNK = 8 << 10


# ---- writing ------------------------------------------------------------------------


def _name(page_id) -> str:
    """The record id of a page; a URI whatever characters the id has."""
    return f"<{_ID}{_NO_ID if page_id is None else quote(str(page_id), safe='-').replace(_NO_ID, '%6Eull')}>"


def _target(url: str | None) -> str | None:
    """A url as a header's value: white space and control characters would end the line."""
    return "".join(quote(c) if c.isspace() or not c.isprintable() else c for c in (url or "").strip()) or None


def chunked(payload: bytes, size: int = _CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record up to the end of its block."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + _END + block


def records_of(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page: a revisit, or a response and its continuations."""
    name = _name(page_id)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", _target(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if is_revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Profile", profile), ("WARC-Refers-To", _name(refers_to)), *common]
        yield _record(fields, status + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    last = -(-len(block) // segment_bytes)
    yield _record([*fields, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for n in range(2, last + 1):
        part = block[(n - 1) * segment_bytes : n * segment_bytes]
        total = len(block) if n == last else None
        yield _record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Date", _DATE),
            ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part)


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, is_revisit): which record each page becomes."""
    raw = F.coalesce(utf8(F.col(payload)) if dict(pages.dtypes)[payload] == "string" else F.col(payload), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Payloads that come once, most of them, have no row here.
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(firsts, "digest", "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisits, F.col("first")).alias("refers_to"), revisits.alias("is_revisit"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, segment_bytes: int = 32 << 10, archive_bytes: int = 32 << 20) -> None:
    """Write a record per page into gzipped archives of about ``archive_bytes`` at most before compression."""
    plan = planned(pages, page_id, url, payload, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = filled = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(6)]
                for record in records_of(*row, segment_bytes):
                    if filled and filled + len(record) > archive_bytes:
                        archive, filled = archive + 1, 0
                    filled += len(record)
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([archive], pa.int32()), "record": pa.array([record], pa.binary())})

    records = mapped(plan, run, "archive int, record binary")
    # A segment may end within a character: the bytes are written as they are. What ends a
    # record is the sink's line separator.
    lines = records.select("archive", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


# ---- reading ------------------------------------------------------------------------


def _unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the last."""
    out: dict[str, str] = {}
    name = ""
    for line in head.split(_END):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """(fields, block, problem) of each record of an archive; a broken one ends it."""
    try:
        data = _unpacked(data)
    except (OSError, EOFError, zlib.error):
        yield {}, None, "broken compression"
        return
    at, size = 0, len(data)
    while at < size:
        end = data.find(b"\r\n\r\n", at)
        line = data[at : at + 10]
        if end < 0 or not line.startswith(b"WARC/1.") or line[8:] != _END:
            yield {}, None, "broken record header"
            return
        fields = _fields(data[at + 10 : end])
        length = fields.get("content-length", "")
        start = end + 4
        if not length.isdecimal() or start + int(length) > size:
            yield fields, None, "block shorter than its length"
            return
        at = start + int(length)
        yield fields, data[start:at], None
        if data[at : at + 4] != b"\r\n\r\n":
            yield {}, None, "no end after a block"
            return
        at += 4


def unchunked(body: bytes) -> bytes:
    """A body without its chunked framing; ValueError if that is broken."""
    parts, at = [], 0
    while True:
        end = body.find(_END, at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("broken chunk size")
        n, at = int(size, 16), end + 2
        if not n:
            # Trailer fields may follow; an empty line is the end.
            if body[at : at + 2] != _END and not body.endswith(b"\r\n\r\n"):
                raise ValueError("no end of chunks")
            return b"".join(parts)
        parts.append(body[at : at + n])
        at += n
        if len(parts[-1]) < n or body[at : at + 2] != _END:
            raise ValueError("chunk shorter than its size")
        at += 2


def http_payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of an HTTP message."""
    head, end, body = block.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP message")
    fields = _fields(head)
    return fields, unchunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body


def _whole(kind: str | None, block: bytes, digest: str | None) -> tuple[bytes | None, int | None, str | None]:
    """(payload, its length, problem) of a whole record."""
    try:
        fields, payload = http_payload(block)
    except ValueError as e:
        return None, None, str(e)
    if kind == "revisit":
        told = fields.get("content-length", "")
        return None, int(told) if told.isdecimal() else None, None
    if digest and digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:].lower():
        return None, None, "digest differs"
    return payload, len(payload), None


_COLUMNS = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")
_HEADERS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest")
_STRINGS = [T.StructField(c, T.StringType()) for c in _COLUMNS]
_PAYLOAD = [T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("problem", T.StringType())]
_ARROW = {"payload": pa.binary(), "payload_bytes": pa.int64(), "block": pa.binary(), "segment": pa.int64(), "total": pa.int64()}


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_pydict({n: pa.array(c, _ARROW.get(n, pa.string())) for n, c in zip(names, columns)})


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdecimal() else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, target_uri, refers_to, payload_digest, payload, payload_bytes, problem) of every record.

    Archives are read a file a row, so a file must fit in memory; ``write_archives`` bounds it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    whole_names, part_names = [*_COLUMNS, *(c.name for c in _PAYLOAD)], [*_COLUMNS, "origin", "segment", "total", "block"]

    def batches_of(batches: Iterator[pa.RecordBatch], row, names: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for fields, block, problem in parsed(content.as_py()):
                    found = row(fields, block, problem)
                    if found is not None:
                        out.append(found)
                        size += len(block or b"")
                    if size > 4 << 20:
                        yield _rows(out, names)
                        out, size = [], 0
                if out:
                    yield _rows(out, names)

    def whole(fields, block, problem):
        if problem is None and "warc-segment-number" in fields:
            return None
        head = tuple(fields.get(h) for h in _HEADERS)
        return (*head, *((None, None, problem) if problem else _whole(head[0], block, head[4])))

    def part(fields, block, problem):
        if problem or "warc-segment-number" not in fields:
            return None
        head = tuple(fields.get(h) for h in _HEADERS)
        return (*head, fields.get("warc-segment-origin-id") or head[1], _number(fields["warc-segment-number"]), _number(fields.get("warc-segment-total-length")), block)

    schema = T.StructType(_STRINGS + _PAYLOAD)
    complete = mapped(files, lambda b: batches_of(b, whole, whole_names), schema)
    extra = [T.StructField("origin", T.StringType()), T.StructField("segment", T.LongType()), T.StructField("total", T.LongType()), T.StructField("block", T.BinaryType())]
    parts = mapped(files, lambda b: batches_of(b, part, part_names), T.StructType(_STRINGS + extra))
    return complete.unionByName(reassembled(parts))


def reassembled(parts: DataFrame) -> DataFrame:
    """Whole records from (record columns, origin, segment, total, block) of their segments.

    A segment that occurs more than once counts once; the record comes as often as its first one.
    """
    once = parts.groupBy("origin", "segment").agg(F.count("*").alias("copies"), F.max("total").alias("total"), *[F.min(c).alias(c) for c in (*_COLUMNS, "block")])
    first = F.when(F.col("segment") == 1, F.struct("copies", *_COLUMNS))
    records = once.groupBy("origin").agg(
        F.max(first).alias("first"), F.max("total").alias("total"), F.max("segment").alias("last"), F.count("*").alias("n"),
        F.sum(F.octet_length("block")).alias("length"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("segments"))
    problem = (
        F.when(F.col("first").isNull(), "first segment missing").when(F.col("total").isNull(), "last segment missing")
        .when(F.col("n") != F.col("last"), "segment missing").when(F.col("length") != F.col("total"), "total length differs"))
    copies = F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col("first.copies"), F.lit(1)).cast("int")))
    named = [F.coalesce(F.col("first.record_id"), F.col("origin")).alias(c) if c == "record_id" else F.col(f"first.{c}").alias(c) for c in _COLUMNS]
    told = records.select(*named, problem.alias("problem"), F.col("segments.block").alias("blocks"), copies.alias("_copy")).drop("_copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *head, problem, blocks = (batch.column(c)[i].as_py() for c in range(7))
                rest = (None, None, problem) if problem else _whole(head[0], b"".join(blocks), head[4])
                yield _rows([(*head, *rest)], [*_COLUMNS, *(c.name for c in _PAYLOAD)])

    return mapped(told, run, T.StructType(_STRINGS + _PAYLOAD))


def _page(record_id):
    """The page's id, as a string, of a record id of ``write_archives``."""
    name = F.regexp_extract(record_id, f"^<{_ID}(.*)>$", 1)
    return F.when((name != "") & (name != _NO_ID), F.url_decode(name))


def query(pages: DataFrame) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back."""
    path = f"{Scratch(pages.sparkSession).root}/archives"
    write_archives(pages, path)
    found = read_archives(pages.sparkSession, path)
    digest = F.coalesce(F.sha2("payload", 256), F.substring_index("payload_digest", ":", -1))
    return found.select(
        _page(F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", digest.alias("payload_digest"),
        "record_type", _page(F.col("refers_to")).cast("long").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
