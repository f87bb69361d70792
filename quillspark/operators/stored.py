"""Indexes that are built once per session and table, and then read by every query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from quillspark.functions.analysis import Analyzer

_built: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can both write: under ``spark.checkpoint.dir``, local only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        return tempfile.mkdtemp(prefix="quillspark-")
    return f"{root}/quillspark-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Batches of at most ``most`` bytes go to Python, however long the texts of a batch are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def index_of(spark: SparkSession, sf_dir: str, analyzer: Analyzer):
    """The written ``Index`` of a folder's documents."""
    from quillspark.operators.index import build_index

    key = (spark.sparkContext.applicationId, sf_dir, analyzer)
    if key not in _built:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        _built[key] = build_index(docs, analyzer).write(shared_folder(spark))
    return _built[key]
