"""Folders of small files as a table: every name is seen, and no file's failure ends the job.

``list_folder`` has (path, length) of each file, also of those whose names begin with . or _,
which Spark's own readers skip. ``read_folder`` has (path, length, text, problem): a file that
cannot be read, is longer than ``most_bytes`` or is no UTF-8 has its problem in words and no
text. ``read_bytes`` has (path, length, content), and a file that cannot be read ends the job.
``write_folder`` writes one file a row into one folder, ``write_dealt`` into a folder for each task.
Paths are those of any filesystem that pyarrow knows and must be reached by the executors. The names
of a folder are listed by the driver and dealt to tasks of ``FILES`` files each; what lies in folders
below it is listed by tasks, one for each of them, so the driver never has all names.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillspark.sources.binary import filesystem, located

NAME = "quill_folder"
FILES = 1000
MOST_BYTES = 256 << 20
_BATCH = 8 << 20


# What is read of each file, by the option ``kind``.
_SCHEMAS = {
    "names": "path string, length bigint", "bytes": "path string, length bigint, content binary",
    "text": "path string, length bigint, text string, problem string"}
_NAMES = {kind: [c.split()[0] for c in columns.split(", ")] for kind, columns in _SCHEMAS.items()}


class _Reader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, most: int | None, kind: str = "text"):
        self.path, self.recursive, self.most, self.kind = path, recursive, most, kind

    def partitions(self) -> list[InputPartition]:
        """Files of the folder itself, and folders in it, by name."""
        fs, root = filesystem(self.path)
        found = fs.get_file_info(files.FileSelector(root))
        rows = sorted((f.path, f.size) for f in found if f.type == files.FileType.File)
        below = sorted(f.path for f in found if f.type == files.FileType.Directory) if self.recursive else []
        return [InputPartition(rows[i : i + FILES]) for i in range(0, len(rows), FILES)] + [InputPartition(x) for x in below]

    @staticmethod
    def _found(fs: files.FileSystem, part: str | list[tuple[str, int]]) -> list[tuple[str, int]]:
        if not isinstance(part, str):
            return part
        below = fs.get_file_info(files.FileSelector(part, recursive=True))
        return sorted((f.path, f.size) for f in below if f.type == files.FileType.File)

    def _row(self, fs: files.FileSystem, path: str, length: int) -> tuple:
        if self.kind == "names":
            return path, length
        if self.kind == "text":
            return path, length, *self._text(fs, path, length)
        with fs.open_input_stream(path, compression=None) as f:
            return path, length, f.read()

    def _text(self, fs: files.FileSystem, path: str, length: int) -> tuple[str | None, str | None]:
        if length > self.most:
            return None, f"longer than {self.most} bytes"
        try:
            with fs.open_input_stream(path, compression=None) as f:
                return f.read().decode("utf-8"), None
        except UnicodeDecodeError as e:
            return None, f"not UTF-8: {e.reason} at position {e.start}"
        except OSError as e:
            return None, f"not readable: {e}"

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = filesystem(self.path)
        kinds = [pa.string(), pa.int64(), pa.large_binary() if self.kind == "bytes" else pa.large_string(), pa.string()]
        narrow = {pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([c.cast(narrow.get(c.type, c.type)) for c in columns], names=_NAMES[self.kind])

        rows, size = [], 0
        for path, length in self._found(fs, partition.value):
            rows.append(self._row(fs, path, length))
            size += 100 if self.kind == "names" else 100 + length
            if size > _BATCH:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class _Writer(DataSourceArrowWriter):
    """A task that runs again writes the same files again."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"{name!r} is no name of a file")
                with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(content.as_py() or b"")
        return WriterCommitMessage()


class _Dealt(DataSourceArrowWriter):
    """Rows of one name come one after another and go to one file, a line feed after each.

    A task that runs again writes the same files again.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        own, last, out = f"{root}/part-{TaskContext.get().partitionId():05d}", None, None
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    fs.create_dir(own, recursive=True)
                if out is None or name != last:
                    if out is not None:
                        out.close()
                    out, last = fs.open_output_stream(f"{own}/name={quote(name, safe=' ')}.txt", compression=None), name
                out.write((content.as_py() or b"") + b"\n")
        if out is not None:
            out.close()
        return WriterCommitMessage()


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMAS[self._kind()]

    def _kind(self) -> str:
        return self.options.get("kind", "names")

    def reader(self, schema) -> _Reader:
        most = int(self.options.get("mostBytes", MOST_BYTES))
        return _Reader(self.options["path"], self.options.get("recursive", "false").lower() == "true", most, self._kind())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return (_Dealt if self.options.get("dealt", "false").lower() == "true" else _Writer)(self.options["path"])


def _source(spark: SparkSession, recursive: bool, kind: str):
    spark.dataSource.register(FolderSource)
    return spark.read.format(NAME).option("recursive", str(recursive).lower()).option("kind", kind)


def list_folder(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length) of every file."""
    return _source(spark, recursive, "names").load(located(path))


def read_folder(spark: SparkSession, path: str, recursive: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, text, problem) of every file; exactly one of the last two is null."""
    return _source(spark, recursive, "text").option("mostBytes", str(most_bytes)).load(located(path))


def read_bytes(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, content) of every file."""
    return _source(spark, recursive, "bytes").load(located(path))


def write_folder(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """A file for each row, as it is; of rows of one name the last that is written stays."""
    rows.sparkSession.dataSource.register(FolderSource)
    raw = rows.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    raw.write.format(NAME).mode("append").save(located(path))


def write_dealt(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """A file ``part-.../name=....txt`` for each name, a folder for each task; a name's rows are lines of its file."""
    rows.sparkSession.dataSource.register(FolderSource)
    raw = rows.select(F.coalesce(F.col(name).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("name"), F.col(content).cast("binary").alias("content"))
    # Rows of one name lie together, so there is one file of it.
    dealt = raw.repartition("name").sortWithinPartitions("name")
    dealt.write.format(NAME).option("dealt", "true").mode("append").save(located(path))
