"""An index in segments that are added, replaced and deleted from, and merged level by level.

All segments lie in one table that is bucketed and sorted by term, so statistics of terms
over any number of segments, and merging them, need no shuffle of postings. A segment holds the
postings and lengths of documents that came together; a document that comes again counts
as it came last, a deletion mark takes it away. Segments are named by a table of one small
row per segment that is written last, so what a lost job leaves is never read.

What is superseded is told to the postings by broadcast, if it is not more than ``marks``
rows; with more, postings are joined by document, which moves them, until ``merge`` has
removed what is superseded.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import LETTERS_PORTER, Analyzer
from quillspark.operators.index import Index, corpus_stats, count_postings, document_lengths, term_stats

MARKS = 1_000_000  # superseded (document, segment) pairs that are broadcast: 16 bytes each
_POSTINGS = "term string, doc_id {kind}, tf bigint, dl bigint, segment bigint"


@dataclass(frozen=True)
class SegmentStore:
    """Segments under ``path``; ``table`` is the name that their bucketed table gets in the session's catalog."""

    spark: SparkSession
    path: str
    table: str
    analyzer: Analyzer = LETTERS_PORTER
    kind: str = "bigint"  # of ids
    buckets: int = 64
    marks: int = MARKS

    def __post_init__(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/postings")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        columns = _POSTINGS.format(kind=self.kind)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet PARTITIONED BY (segment) "
            f"CLUSTERED BY (term) SORTED BY (term) INTO {self.buckets} BUCKETS LOCATION '{self.path}/postings'")
        # Of segments that another session has written.
        self.spark.sql(f"MSCK REPAIR TABLE {self.table}")

    # ---- segments --------------------------------------------------------------------

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def segments(self) -> list[tuple[int, int]]:
        """(segment, level) of those that count, oldest first; there are few."""
        rows = self._read("segments", "segment bigint, level int, merged array<bigint>").collect()
        gone = {s for r in rows for s in r["merged"]}
        return sorted((r["segment"], r["level"]) for r in rows if r["segment"] not in gone)

    def _commit(self, segment: int, level: int, merged: list[int]) -> None:
        row = self.spark.createDataFrame([(segment, level, merged)], "segment bigint, level int, merged array<bigint>")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def _next(self) -> int:
        """A new name, above all others; its last bits tell it from one that a lost job has used."""
        last = max((s for s, _ in self.segments()), default=0)
        return ((last >> 20) + 1) << 20 | random.getrandbits(20)

    def _write_documents(self, docs: DataFrame, segment: int) -> None:
        docs.select("doc_id", "dl", "failed", "deleted").write.parquet(f"{self.path}/documents/segment={segment}")

    def _write_postings(self, postings: DataFrame, segment: int) -> None:
        rows = postings.select("term", "doc_id", "tf", "dl", F.lit(segment).cast("long").alias("segment"))
        rows.write.mode("append").format("parquet").option("path", f"{self.path}/postings").partitionBy("segment").bucketBy(self.buckets, "term").sortBy("term").saveAsTable(self.table)

    # ---- changes ---------------------------------------------------------------------

    def add(self, docs: DataFrame) -> int:
        """Add (doc_id, text) rows, or replace those whose ids are there; ids are unique in ``docs``."""
        segment = self._next()
        postings = count_postings(docs, self.analyzer)
        # Each bucket's rows in one task, so that a segment has one file a bucket.
        self._write_postings(postings.repartition(self.buckets, "term"), segment)
        self._write_documents(document_lengths(docs, self.analyzer).withColumn("deleted", F.lit(False)), segment)
        self._commit(segment, 0, [])
        return segment

    def delete(self, ids: DataFrame) -> int:
        """Take the documents of ``ids`` (doc_id) away."""
        segment = self._next()
        marks = ids.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("dl"), F.lit(False).alias("failed"), F.lit(True).alias("deleted"))
        self._write_documents(marks, segment)
        self._commit(segment, 0, [])
        return segment

    # ---- reading ---------------------------------------------------------------------

    def _documents(self, names: list[int]) -> DataFrame:
        docs = self._read("documents", f"doc_id {self.kind}, dl bigint, failed boolean, deleted boolean, segment bigint")
        return docs.where(F.col("segment").isin(names))

    def _latest(self, names: list[int]) -> DataFrame:
        """Each document as it came last, deletion marks, too."""
        last = F.max(F.struct("segment", "dl", "failed", "deleted")).alias("x")
        return self._documents(names).groupBy("doc_id").agg(last).select("doc_id", "x.*")

    def _postings(self, names: list[int], among: list[int]) -> DataFrame:
        """Postings in the segments ``names`` of documents that no segment of ``among`` supersedes."""
        postings = self.spark.table(self.table).where(F.col("segment").isin(names))
        gone = self._documents(names).where("not deleted").select("doc_id", "segment").join(
            self._latest(among).where("not deleted").select("doc_id", "segment"), ["doc_id", "segment"], "left_anti")
        if gone.limit(self.marks + 1).count() <= self.marks:
            gone = F.broadcast(gone)
        return postings.join(gone, ["doc_id", "segment"], "left_anti").select("term", "doc_id", "tf", "dl")

    def index(self, population: str = "indexed") -> Index:
        """An index over what counts."""
        names = [s for s, _ in self.segments()]
        postings = self._postings(names, names)
        docs = self._latest(names).where("not deleted").select("doc_id", "dl", "failed")
        return Index(postings, docs, term_stats(postings), corpus_stats(docs), self.analyzer, population)

    # ---- merging ---------------------------------------------------------------------

    def merge(self, fan: int = 4) -> list[int]:
        """Merge the youngest segments of one level into one of the next, wherever a level has ``fan``; return the new ones.

        A document is so written once a level, and levels grow with the logarithm of all.
        """
        made: list[int] = []
        while True:
            active = self.segments()
            levels = [x for _, x in active]
            # Levels fall with age, so those of one level are neighbours.
            full = next((x for x in sorted(set(levels)) if levels.count(x) >= fan), None)
            if full is None:
                return made
            names, every = [s for s, x in active if x == full], [s for s, _ in active]
            made.append(self._merged(names, every, full + 1))

    def compact(self) -> int | None:
        """Merge all segments into one, and forget all deletion marks."""
        active = self.segments()
        names = [s for s, _ in active]
        return self._merged(names, names, max(x for _, x in active) + 1) if active else None

    def _merged(self, names: list[int], every: list[int], level: int) -> int:
        # The merged segment takes the place of its youngest part in the order of age.
        segment = max(names) + 1
        while segment in every:
            segment += 1
        self._write_postings(self._postings(names, every), segment)
        docs = self._latest(names)
        if names[0] == every[0]:
            docs = docs.where("not deleted")  # nothing older is left that a mark could hide
        self._write_documents(docs, segment)
        self._commit(segment, level, names)
        return segment
