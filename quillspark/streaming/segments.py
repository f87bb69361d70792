"""New documents become index segments batch by batch; compaction merges them.

Each micro-batch writes the postings and lengths of its documents under its batch number,
so that a batch that is run again replaces itself. Statistics are computed from what is
stored, so there is no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.analysis import LETTERS_PORTER, Analyzer
from quillspark.operators.index import Index, corpus_stats, count_postings, document_lengths, term_stats


def index_stream(docs: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = LETTERS_PORTER) -> StreamingQuery:
    """Start indexing a stream of (doc_id, text) into segments under ``path``; ends when all there is was read."""

    def add(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            count_postings(kept, analyzer).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
            document_lengths(kept, analyzer).write.mode("overwrite").parquet(f"{path}/doc_stats/batch={number}")
        finally:
            kept.unpersist()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_segments(spark: SparkSession, path: str, analyzer: Analyzer = LETTERS_PORTER, population: str = "indexed") -> Index:
    """An index over all segments; a document that came again in a later batch counts once, as it came last."""
    lengths = spark.read.parquet(f"{path}/doc_stats")
    latest = lengths.groupBy("doc_id").agg(F.max(F.struct("batch", "dl", "failed")).alias("x")).select("doc_id", "x.*")
    postings = spark.read.parquet(f"{path}/postings").join(latest.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")
    # Each document is of one batch now, whose rows are added up: there is nothing to merge.
    postings = postings.select("term", "doc_id", "tf", "dl")
    doc_stats = latest.select("doc_id", "dl", "failed")
    return Index(postings, doc_stats, term_stats(postings), corpus_stats(doc_stats), analyzer, population)


def compact(spark: SparkSession, path: str, target: str, analyzer: Analyzer = LETTERS_PORTER) -> Index:
    """Merge all segments into one written index."""
    return read_segments(spark, path, analyzer).write(target)
