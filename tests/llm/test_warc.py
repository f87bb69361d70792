import gzip
import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def want(rows):
    """What the query returns, by a dictionary of first ids."""
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        f = first.get(raw, i)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    return Counter(out)


def page_rows():
    rng = random.Random(3)
    long = "".join(rng.choice("añ日\U0001f600\r\n<>") for _ in range(60_000))
    same = "<p>WARC/1.1\r\n\r\n0\r\n\r\n</p>" * 9
    rows = [(i, f"http://h/{i}", rng.choice([same, "short", long, f"<html>{i}</html>" * rng.randint(1, 3000)])) for i in range(60, 0, -1)]
    rows += [(100, None, None), (101, "", ""), (102, "http://a b\r\nX: y", "é" * 49), (103, "u", "é" * 50), (104, "u", "é" * 50), (105, "u", "x" * 99), (106, "u", "x" * 99), (None, "u", "nothing")]
    # Repeated rows: short, revisits, and in segments.
    return rows + [(101, "", ""), (104, "u", "é" * 50), (200, "u", long + "!"), (200, "u", long + "!")]


def test_query_equals_brute_force(spark):
    rows = page_rows()
    got = warc.query(spark.createDataFrame(rows, PAGES).repartition(3))
    assert Counter(map(tuple, got.collect())) == want(rows)
    assert warc.query(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_and_targets_come_back(spark, tmp_path):
    rows = [r for r in page_rows() if r[0] not in (101, 104, 200)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"payload": F.lit(1), "digest": F.lit("clash"), "archive": F.lit(None)})
    warc.write_archives(pages, f"{tmp_path}/a", segment_bytes=1000, archive_bytes=100_000)
    back = {r.record_id: r for r in warc.read_archives(spark, f"{tmp_path}/a").collect()}
    assert len(back) == len(rows) and not any(r.problem for r in back.values())
    for i, url, html in rows:
        r = back[f"<urn:page:{'null' if i is None else i}>"]
        raw = (html or "").encode()
        assert r.payload_bytes == len(raw)
        assert bytes(r.payload) == raw if r.record_type == "response" else r.payload is None and r.refers_to in back
    assert back["<urn:page:102>"].target_uri == "http://a%20b%0D%0AX:%20y" and back["<urn:page:100>"].target_uri is None
    sizes = [len(gzip.decompress(f.read_bytes())) for f in Path(tmp_path, "a").rglob("*.gz")]
    assert len(sizes) > 1 and max(sizes) <= 101_000 + 4 * 100


def test_ids_of_any_text(spark, tmp_path):
    ids = ["null", "a b>", "é:1", "", "x/y%"]
    warc.write_archives(spark.createDataFrame([(i, "u", f"<p>{i}") for i in ids], "page_id string, url string, html string"), f"{tmp_path}/a")
    found = warc.read_archives(spark, f"{tmp_path}/a").select(warc._page(F.col("record_id")).alias("i"), F.col("payload").cast("string").alias("p")).collect()
    assert {r.p: r.i for r in found} == {f"<p>{i}": i or None for i in ids}


def _archive(*records):
    return b"".join(r + b"\r\n\r\n" for r in records)


def test_what_is_broken_is_told(spark, tmp_path):
    payload = bytes(range(256)) * 20
    digest = hashlib.sha256(payload).hexdigest()
    of = lambda i, d=digest: list(warc.records_of(i, "u", payload, d, None, False, 1500))
    plain = next(warc.records_of(9, "u", payload, digest, None, False, 1 << 20))
    files = {
        "shuffled.warc": _archive(*reversed(of(1))), "gap.warc": _archive(*(r for k, r in enumerate(of(2)) if k != 1)),
        "headless.warc": _archive(*of(3)[1:]), "endless.warc": _archive(*of(4)[:-1]),
        "digest.warc": _archive(*of(5, "0" * 64)), "length.warc": _archive(*[r.replace(b"Total-Length: 5", b"Total-Length: 6") for r in of(6)]),
        "frame.warc": _archive(plain.replace(b"\r\n1400\r\n", b"\r\n1401\r\n")), "cut.warc": _archive(plain)[:2000], "junk.warc": b"not an archive\r\n\r\n",
        "cut.warc.gz": gzip.compress(_archive(plain))[:-20], "members.warc.gz": gzip.compress(_archive(*of(7)[:2])) + gzip.compress(_archive(*of(7)[2:])),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {(r.record_id, r.problem) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    page = "<urn:page:{}>".format
    assert got == {
        (page(1), None), (page(2), "segment missing"), (page(3), "first segment missing"), (page(4), "last segment missing"), (page(5), "digest differs"),
        (page(6), "total length differs"), (page(9), "chunk shorter than its size"), (page(9), "block shorter than its length"), (None, "broken record header"),
        (None, "broken compression"), (page(7), None)}


def test_chunks():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        assert warc.unchunked(warc.chunked(b"\r\n0" * n)) == b"\r\n0" * n
    assert warc.unchunked(b"3;x=y\r\nabc\r\n00\r\nTrailer: z\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"0\r\n", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
