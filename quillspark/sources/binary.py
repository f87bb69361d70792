"""A binary index on disk that is written in parts, small, and read by term without a scan.

``write_binary`` stores (term, doc_id) rows, ``read_binary`` reads them back; a filter on
``term`` (``=`` or ``IN``) reaches the source, which then finds each term by binary search in
a part's offset table and reads the blocks of that term alone.

A part holds a range of (term, doc_id), sorted. Its rows lie in blocks of about
``BLOCK_BYTES``; a block has entries of at most ``ENTRY_IDS`` ids of one term, so a frequent
term has many entries and no list is ever in one row. Terms are written without the start
that they share with the term before. Ids that are integers are gaps of variable byte
length; others lose the start that they share, too. An entry's head tells how many ids
and bytes it has, so that other terms' entries are skipped. After the blocks come the first
terms of all blocks, the offset table, and a footer.

Parts are listed in a manifest that is written last: what a lost task has left is never
read. Paths are those of any filesystem that pyarrow knows (a local or mounted path,
hdfs://, s3://, ...) and must be reached by the executors.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from quillspark.operators.index import by_range

NAME = "quill_binary"
BLOCK_BYTES = 4 << 10
ENTRY_IDS = 1024
MANIFEST = "_parts.json"
_TABLE = struct.Struct(">QIQI")  # of a block: offset, bytes, offset and bytes of its first term
_FOOTER = struct.Struct(">QQ8s")  # offset of the table, number of blocks
_MAGIC = b"quillbin"
_TERMS = 256  # that one task looks up in a part
_SCANNED = 4096  # blocks that one task scans
_AHEAD = 1 << 20  # bytes of blocks that are read at once


# ---- numbers and entries -----------------------------------------------------------

_SMALL = [bytes([n]) for n in range(128)]


def _varint(n: int) -> bytes:
    if n < 128:
        return _SMALL[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _unzigzag(n: int) -> int:
    return n >> 1 if not n & 1 else -(n + 1 >> 1)


def varints(values: np.ndarray) -> bytes:
    """Unsigned numbers in groups of seven bits, low ones first; the last byte of each is below 128."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        size += v >= np.uint64(1 << bits)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        byte = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = byte.astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


class _Bytes:
    """Numbers and bytes, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


_FEW = 16
_MASK = (1 << 64) - 1  # gaps wrap around as in 64-bit arithmetic


def _entry(before: bytes, term: bytes, ids: list) -> bytes:
    n = _shared(before, term)
    head = _varint(n) + _varint(len(term) - n) + term[n:] + _varint(len(ids))
    if isinstance(ids[0], int):
        if len(ids) <= _FEW:  # most terms are rare, and arrays cost more than they save
            body = b"".join(_varint(b - a & _MASK) for a, b in zip(ids, ids[1:]))
            return head + _varint(_zigzag(ids[0])) + _varint(len(body)) + body
        body = varints(np.diff(np.asarray(ids, np.int64)).astype(np.uint64))
        return head + _varint(_zigzag(ids[0])) + _varint(len(body)) + body
    raw, body, last = [i.encode() for i in ids], bytearray(), b""
    for r in raw:
        n = _shared(last, r)
        body += _varint(n) + _varint(len(r) - n) + r[n:]
        last = r
    return head + _varint(len(body)) + bytes(body)


def _entries(block: bytes, ints: bool, wanted: bytes | None = None) -> Iterator[tuple[bytes, list]]:
    """(term, ids) of a block, or those of one term; other terms' ids are skipped."""
    b, term = _Bytes(block), b""
    while b.at < len(block):
        term = term[: b.number()] + b.take(b.number())
        n = b.number()
        first = _unzigzag(b.number()) if ints else 0
        size = b.number()
        if wanted is not None and term != wanted:
            if term > wanted:
                return
            b.at += size
            continue
        body = b.take(size)
        if ints:
            # Sums of gaps may wrap around and come back: ids are 64-bit integers.
            yield term, np.cumsum(np.r_[np.int64(first), from_varints(body).astype(np.int64)]).tolist()
        else:
            r, last, ids = _Bytes(body), b"", []
            for _ in range(n):
                last = last[: r.number()] + r.take(r.number())
                ids.append(last.decode())
            yield term, ids


# ---- files --------------------------------------------------------------------------


def located(path: str) -> str:
    """A path that means the same to the driver and to executors: relative ones are the driver's."""
    return path if ":" in path.split("/")[0] else os.path.abspath(path)


def filesystem(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path)


def read_manifest(path: str) -> dict:
    fs, root = filesystem(path)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def write_manifest(path: str, manifest: dict) -> None:
    """Replace the manifest, then delete the parts that only the one before names."""
    fs, root = filesystem(path)
    old = []
    if fs.get_file_info(f"{root}/{MANIFEST}").type == files.FileType.File:
        old = [p["name"] for p in read_manifest(path)["parts"]]
    with fs.open_output_stream(f"{root}/{MANIFEST}.new") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
    delete_parts(path, set(old) - {p["name"] for p in manifest["parts"]})


def delete_parts(path: str, names: Iterable[str]) -> None:
    fs, root = filesystem(path)
    for name in names:
        if fs.get_file_info(f"{root}/{name}").type == files.FileType.File:
            fs.delete_file(f"{root}/{name}")


class Part:
    """A part, open for reading; ``bytes_read`` tells what it has read."""

    def __init__(self, path: str, name: str, ints: bool):
        fs, root = filesystem(path)
        self.file, self.ints, self.bytes_read = fs.open_input_file(f"{root}/{name}"), ints, 0
        self.table_at, self.blocks, magic = _FOOTER.unpack(self._at(self.file.size() - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{name} is no part of a binary index")

    def __enter__(self) -> "Part":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _at(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self.file.read_at(n, at)

    def _first_term(self, block: int) -> bytes:
        _, _, at, n = _TABLE.unpack(self._at(self.table_at + block * _TABLE.size, _TABLE.size))
        return self._at(at, n)

    def _search(self, term: bytes, beyond: bool) -> int:
        """The first block that begins with ``term`` or a later one, or only with a later one."""
        lo, hi = 0, self.blocks
        while lo < hi:
            middle = (lo + hi) // 2
            first = self._first_term(middle)
            if first > term or first == term and not beyond:
                hi = middle
            else:
                lo = middle + 1
        return lo

    def scan(self, lo: int, hi: int, term: bytes | None = None) -> Iterator[tuple[bytes, list]]:
        """(term, ids) of the entries in blocks ``lo`` to ``hi``, in order."""
        while lo < hi:
            table = [_TABLE.unpack(x) for x in _cut(self._at(self.table_at + lo * _TABLE.size, _TABLE.size * min(256, hi - lo)), _TABLE.size)]
            n = 1
            while n < len(table) and sum(x[1] for x in table[: n + 1]) <= _AHEAD:
                n += 1
            data, at = self._at(table[0][0], sum(x[1] for x in table[:n])), 0
            for _, size, _, _ in table[:n]:
                yield from _entries(data[at : at + size], self.ints, term)
                at += size
            lo += n

    def find(self, term: bytes) -> Iterator[list]:
        """The ids of a term, entry by entry."""
        lo = self._search(term, False)
        # The term may begin within the block before.
        for _, ids in self.scan(max(0, lo - 1), self._search(term, True), term):
            yield ids


def _cut(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


class PartWriter:
    """Writes sorted (term, ids) runs into a part."""

    def __init__(self, path: str):
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        self.name = f"part-{uuid.uuid4().hex}.bin"
        self.file = fs.open_output_stream(f"{root}/{self.name}")
        self.at, self.table, self.firsts = 0, [], []
        self.block, self.last = bytearray(), b""
        self.last_term = b""

    def add(self, term: bytes, ids: list) -> None:
        if not self.block:
            self.firsts.append(term)
            self.last = b""
        self.block += _entry(self.last, term, ids)
        self.last = self.last_term = term
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.file.write(bytes(self.block))
            self.table.append((self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> dict:
        self._flush()
        self.file.write(b"".join(self.firsts))
        at, rows = self.at, []
        for (offset, size), term in zip(self.table, self.firsts):
            rows.append(_TABLE.pack(offset, size, at, len(term)))
            at += len(term)
        self.file.write(b"".join(rows) + _FOOTER.pack(at, len(rows), _MAGIC))
        self.file.close()
        size = at + len(rows) * _TABLE.size + _FOOTER.size
        return {"name": self.name, "first": self.firsts[0].decode(), "last": self.last_term.decode(), "blocks": len(rows), "bytes": size}


# ---- the data source ---------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    part: dict | None


def sorted_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list]]:
    """(term, at most ``most`` ids) of sorted (term, doc_id) batches."""
    term, ids = None, []
    for batch in batches:
        terms, found = batch.column(0), batch.column(1)
        # Arrays make lists many times faster than Arrow does, but have no nulls.
        found = found.to_pylist() if found.null_count else found.to_numpy(zero_copy_only=False).tolist()
        # Where the term changes, so that Python sees each run once and not each row.
        same = pa.compute.equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False) if len(terms) > 1 else np.zeros(0, bool)
        edges = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist(), len(terms)]
        for t, lo, hi in zip(terms.take(pa.array(edges[:-1])).to_pylist() if len(terms) else (), edges, edges[1:]):
            if t != term and ids:
                yield term, ids
                ids = []
            term = t
            while lo < hi:
                n = min(hi - lo, most - len(ids))
                ids += found[lo : lo + n]
                lo += n
                if len(ids) == most:
                    yield term, ids
                    ids = []
    if ids:
        yield term, ids


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, ints: bool, overwrite: bool):
        self.path, self.ints, self.overwrite = path, ints, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        part = None
        for term, ids in sorted_runs(iterator, ENTRY_IDS):
            part = part or PartWriter(self.path)
            part.add(term.encode(), ids)
        return _Written(part and part.close())

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        parts = sorted((m.part for m in messages if m and m.part), key=lambda p: (p["first"].encode(), p["last"].encode()))
        if not self.overwrite and fs.get_file_info(f"{root}/{MANIFEST}").type == files.FileType.File:
            raise FileExistsError(self.path)
        write_manifest(self.path, {"ints": self.ints, "parts": parts})

    def abort(self, messages) -> None:
        delete_parts(self.path, [m.part["name"] for m in messages if m and m.part])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.terms = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("term",):
                found = set(f.value) if isinstance(f, In) else {f.value}
                self.terms = found if self.terms is None else self.terms & found
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        manifest, out = read_manifest(self.path), []
        wanted = None if self.terms is None else sorted(t.encode() for t in self.terms if t is not None)
        for p in manifest["parts"]:
            if wanted is None:
                out += [(p["name"], manifest["ints"], lo, min(lo + _SCANNED, p["blocks"])) for lo in range(0, p["blocks"], _SCANNED)]
                continue
            first, last = p["first"].encode(), p["last"].encode()
            here = wanted[bisect_left(wanted, first) : bisect_right(wanted, last)]
            out += [(p["name"], manifest["ints"], here[i : i + _TERMS]) for i in range(0, len(here), _TERMS)]
        return [InputPartition(x) for x in out]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        name, ints, *what = partition.value
        kind = pa.int64() if ints else pa.string()

        def batch(rows: list[tuple[bytes, list]]) -> pa.RecordBatch:
            sizes = [len(ids) for _, ids in rows]
            terms = pa.array([t.decode() for t, _ in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), sizes)))
            return pa.RecordBatch.from_arrays([terms, pa.array([i for _, ids in rows for i in ids], kind)], names=["term", "doc_id"])

        with Part(self.path, name, ints) as part:
            found = part.scan(*what) if len(what) == 2 else ((t, ids) for t in what[0] for ids in part.find(t))
            rows, n = [], 0
            for row in found:
                rows.append(row)
                n += len(row[1])
                if n > 8 * ENTRY_IDS:
                    yield batch(rows)
                    rows, n = [], 0
            if rows:
                yield batch(rows)


class BinaryIndexSource(DataSource):
    """Rows (term STRING, doc_id BIGINT or STRING)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"term string, doc_id {'bigint' if read_manifest(self.options['path'])['ints'] else 'string'}"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema["doc_id"].dataType.typeName() in ("long", "integer"), overwrite)


def write_binary(postings: DataFrame, path: str) -> None:
    """Replace the binary index at ``path`` by the (term, doc_id) rows of ``postings``."""
    spark = postings.sparkSession
    spark.dataSource.register(BinaryIndexSource)
    ids = "doc_id" if dict(postings.dtypes)["doc_id"] in ("bigint", "string") else "cast(doc_id as string) as doc_id"
    rows = by_range(postings.selectExpr("term", ids), postings.count(), "term", "doc_id").sortWithinPartitions("term", "doc_id")
    rows.write.format(NAME).mode("overwrite").save(located(path))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id) of a binary index; filters on ``term`` are look-ups."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinaryIndexSource)
    return spark.read.format(NAME).load(located(path))


def stored_bytes(path: str) -> int:
    """Bytes of all parts."""
    return sum(p["bytes"] for p in read_manifest(path)["parts"])
