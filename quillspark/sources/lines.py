"""Text indexes, lines ``term: id1, id2``, written and read piece by piece.

A line is a term's whole list, however long: the sink gets sorted rows and appends to the
line as they come, and the source hands out ids while it reads on, so neither has a list in
a row. Ranges of terms go to a file each, terms ascend over the files in name order, ids are
in string order. A frequent term's line is written by one task in constant memory, after
Spark's sort of its range, which spills if need be.

A line without ``: `` is skipped, and so are blank ids and blanks around ids. An id with a
comma and a space in it comes back as two.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from quillspark.operators.index import by_range
from quillspark.sources.binary import _Written, delete_parts, filesystem, located, sorted_runs, write_manifest

NAME = "quill_lines"
_PIECE = 1 << 20  # bytes that are read, and ids' bytes that are written, at once
_IDS = 8192


def _ids(line: bytes) -> list[bytes]:
    return [x for x in (i.strip(b" \r") for i in line.split(b", ")) if x]


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """(term, some of its ids), in order, of a file that comes in pieces."""
    rest, term, over = b"", None, False
    while not over:
        piece = next(pieces, b"")
        over = not piece
        rest += piece
        while rest:
            end = rest.find(b"\n")
            if term is None:
                at = rest.find(b": ")
                if at >= 0 and not 0 <= end < at:
                    term, rest = rest[:at].strip(b" "), rest[at + 2 :]
                elif end >= 0 or over:
                    rest = rest[end + 1 :] if end >= 0 else b""
                else:
                    break
                continue
            if end >= 0 or over:
                line = rest[:end] if end >= 0 else rest
                yield term, _ids(line)
                rest, term = rest[end + 1 :] if end >= 0 else b"", None
                continue
            end = rest.rfind(b", ")
            if end >= 0:
                yield term, _ids(rest[:end])
                rest = rest[end + 2 :]
            break


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, out, last = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.txt", None, None
        for term, ids in sorted_runs(iterator, _IDS):
            out = out or fs.open_output_stream(f"{root}/{name}")
            start = ", " if term == last else f"{term}: " if last is None else f"\n{term}: "
            out.write((start + ", ".join(ids)).encode())
            last = term
        if out is None:
            return _Written(None)
        out.write(b"\n")
        out.close()
        return _Written({"name": name})

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        write_manifest(self.path, {"parts": [m.part for m in messages if m and m.part]})

    def abort(self, messages) -> None:
        delete_parts(self.path, [m.part["name"] for m in messages if m and m.part])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """A task for each file of the folder; names that begin with . or _ are no indexes."""
        fs, root = filesystem(self.path)
        if fs.get_file_info(root).type == files.FileType.File:
            return [InputPartition(root)]
        found = fs.get_file_info(files.FileSelector(root))
        return [InputPartition(f.path) for f in found if f.type == files.FileType.File and f.base_name[0] not in "._"]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_stream(partition.value) as f:
            terms, sizes, found = [], [], []
            for term, ids in parsed(iter(lambda: f.read(_PIECE), b"")):
                terms.append(term)
                sizes.append(len(ids))
                found += ids
                if len(found) >= _IDS:
                    yield self._batch(terms, sizes, found)
                    terms, sizes, found = [], [], []
            if found:
                yield self._batch(terms, sizes, found)

    @staticmethod
    def _batch(terms: list[bytes], sizes: list[int], ids: list[bytes]) -> pa.RecordBatch:
        """``sizes`` tells how many of the ids each term has."""
        text = lambda c: pa.array([x.decode("utf-8", "replace") for x in c], pa.string())
        return pa.RecordBatch.from_arrays([text(terms).take(pa.array(np.repeat(np.arange(len(terms)), sizes), pa.int64())), text(ids)], names=["term", "doc_id"])


class TextIndexSource(DataSource):
    """Rows (term STRING, doc_id STRING)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "term string, doc_id string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_lines(postings: DataFrame, path: str) -> None:
    """Replace the text index at ``path`` by the (term, doc_id) rows of ``postings``."""
    postings.sparkSession.dataSource.register(TextIndexSource)
    rows = postings.select("term", F.col("doc_id").cast("string").alias("doc_id"))
    by_range(rows, rows.count(), "term").sortWithinPartitions("term", "doc_id").write.format(NAME).mode("overwrite").save(located(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id) of a text index, a file or a folder of them."""
    spark.dataSource.register(TextIndexSource)
    return spark.read.format(NAME).load(located(path))
