"""Sources and sinks: text files, text indexes, settings, and the small ranking fixture."""

from __future__ import annotations

import configparser
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import folder
from quillspark.sources.lines import write_lines


@dataclass(frozen=True)
class Settings:
    input_directory: str
    block_size: int
    output_file: str


def read_settings(path: str = "config.ini", spark: SparkSession | None = None) -> Settings:
    """Settings of a file of the driver, or, given a session, of one that Spark's readers reach."""
    parser = configparser.ConfigParser()
    if spark is not None:
        parser.read_string("\n".join(r[0] for r in spark.read.text(path).collect()))
    elif not parser.read(path):
        raise FileNotFoundError(path)
    s = parser["Settings"]
    return Settings(s["input_directory"], int(s["block_size"]), s["output_file"])


def list_files(spark: SparkSession, directory: str, dealt: bool = False) -> DataFrame:
    """Paths and sizes of a directory's files, not recursive; names that begin with . or _ are not seen.

    Here and below, ``dealt``: the directory is one of ``write_files``. Tasks list its folders, so
    the driver has no table of all files, and a task reads a folder, not a few files.
    """
    if dealt:
        return folder.list_folder(spark, directory, recursive=True)
    return spark.read.format("binaryFile").load(directory).select("path", "length")


def _contents(spark: SparkSession, directory: str, dealt: bool) -> DataFrame:
    return folder.read_bytes(spark, directory, recursive=True) if dealt else spark.read.format("binaryFile").load(directory)


def read_corpus(spark: SparkSession, directory: str, strict: bool = False, dealt: bool = False) -> DataFrame:
    """(doc_id, text), a row per file. ``strict`` raises on bytes that are no UTF-8, else they are dropped."""
    if strict:
        return _contents(spark, directory, dealt).select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
    if dealt:
        files = _contents(spark, directory, dealt).select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("value"))
    else:
        files = spark.read.text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return files.select("doc_id", F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")).alias("text"))


def read_quarantined(spark: SparkSession, directory: str, dealt: bool = False) -> DataFrame:
    """(doc_id, text) with a null text, not an error, for files that are no UTF-8."""
    files = _contents(spark, directory, dealt)
    return files.select(F.col("path").alias("doc_id"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def read_text_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, postings) from lines ``term: id1, id2``; lines without a colon are skipped."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(":"))).select(F.trim("value").alias("value"))
    parts = F.split("value", ": ", 2)
    return lines.select(F.get(parts, F.lit(0)).alias("term"), F.split(F.get(parts, F.lit(1)), ", ").alias("postings"))


def text_index_postings(lists: DataFrame) -> DataFrame:
    """Postings rows (term, doc_id, tf, dl) of a text index, which knows no counts: tf is 1 and dl 0."""
    rows = lists.select("term", F.explode("postings").alias("doc_id")).distinct().withColumn("tf", F.lit(1).cast("long"))
    return rows.withColumn("dl", F.lit(0).cast("long"))


def write_text_index(postings: DataFrame, path: str) -> None:
    """Lines ``term: id1, id2``, terms ascending over all part files in name order, ids in string order."""
    write_lines(postings, path)


def write_segment(postings: DataFrame, path: str) -> None:
    """A block of an index under construction: postings sorted by term, then id, inside each file.

    A frequent term's rows lie in many ranges, so no task sorts all of them.
    """
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("append").parquet(path)


def write_files(texts: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """A directory with one file for each row, named by the column ``name``; ``content`` is text or bytes.

    Files end with a line feed. Each is ``name=....txt`` in one of as many folders as tasks wrote,
    which ``read_corpus`` and its like take as ``path/*``, or as ``path`` if told that it is dealt.
    What was at ``path`` before is deleted.
    """
    spark = texts.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    folder.write_dealt(texts, path, name, content)


# The documents of the ranking fixture.
RANKING_DOCS = [
    ("doc1.txt", "apple apple apple banana"),
    ("doc2.txt", "apple banana banana banana"),
    ("doc3.txt", "apple banana orange grape"),
    ("doc4.txt", "apple banana cherry date elderberry fig grape"),
    ("doc5.txt", "rare_term apple banana"),
    ("doc8.txt", "common common common rare_term"),
    ("doc9.txt", "apple apple"),
    ("doc10.txt", "apple banana common"),
]


def ranking_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANKING_DOCS, "doc_id string, text string")


def metrics_report(spark: SparkSession, seconds: dict[str, float], memory_mb: dict[str, float], n_blocks: int) -> DataFrame:
    """The build report as one row: times, memory figures and the number of blocks."""
    values = {f"{k}_s": float(v) for k, v in seconds.items()} | {f"{k}_mb": float(v) for k, v in memory_mb.items()}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(n_blocks).cast("long").alias("n_blocks"))
