"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Characters that separate words in every contract of this subpackage.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; the path goes only through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without the setting gets a temporary folder; on a cluster that
    would lie on one machine's disk, so its absence is an error there.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        found = sc.getCheckpointDir()
    return found


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive executors.

    A table that is superseded is deleted with ``drop`` or ``drop_all_but``; one that a
    returned, still lazy DataFrame reads stays until the owner of the shared folder clears it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
        self._kept: list[tuple[DataFrame, str]] = []
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((out, path))
        return out

    def counted(self, df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
        """``keep``, and how many ``rows`` there are and how many meet each condition, told by the same write."""
        seen = Observation()
        found = [F.count_if(c).alias(name) for name, c in conditions.items()]
        return self.keep(df.observe(seen, F.count(F.lit(1)).alias("rows"), *found)), seen.get

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for df, path in [x for x in self._kept if any(x[0] is t for t in tables)]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            self._kept = [x for x in self._kept if x[1] != path]

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*[df for df, _ in self._kept if not any(df is t for t in tables)])


class BoundedMemory(dict):
    """Values by key, made when first asked for; what it holds is bounded.

    Two generations of ``entries`` each: what is in use survives when the younger is full.
    Keys longer than ``longest`` are never held, so that the bound in entries is one in
    bytes, for values that grow with their keys.
    """

    def __init__(self, make, entries: int = 40_000, longest: int = 32):
        super().__init__()
        self.make, self.entries, self.longest = make, entries, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self.hold(key, value)
        return value

    def hold(self, key, value) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value


_slot: dict[object, object] = {}


def remembered(key: object, make):
    """``make()``, kept in this Python worker for its next tasks until another model is asked for.

    Called by reference from workers, so that the store is this module's and not a copy that
    travels with each task.
    """
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
    return _slot[key]


class _Measure:
    """A file that keeps nothing of what is written but its size."""

    def __init__(self):
        self.size = 0

    def write(self, data) -> int:
        n = memoryview(data).nbytes
        self.size += n
        return n


def broadcast(spark: SparkSession, value: object, limit: int):
    """Broadcast a value whose pickled size is proven to be at most ``limit`` bytes.

    Workers read it as it is, so that no second copy of a model stays beside its pickle; the
    driver measures the pickle without holding it.
    """
    measure = _Measure()
    cloudpickle.dump(value, measure)
    if measure.size > limit:
        raise ValueError(f"model of {measure.size} bytes is over its broadcast bound of {limit}")
    return spark.sparkContext.broadcast(value)


_BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of at most ``_BATCH_BYTES`` from now on.

    Spark's own bound of 64 MB, with what buffers grow by, is much beside the memory of an
    executor and of a worker. The bound is a setting of the session; a smaller one stays.
    """
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", conf.get(_BATCH_SETTING).strip().lower()).groups()
    if not 0 < int(number) * 1024 ** " kmgtp".index(unit or " ") <= _BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(_BATCH_BYTES))
    return df


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with bounded batches."""
    return bound_batches(df).mapInArrow(run, schema)


def running_offsets(counts: DataFrame, bucket: str, count: str, by: list[str], block: int = 512) -> DataFrame:
    """Add ``before``: the sum of ``count`` over smaller buckets of the same ``by`` group.

    ``counts`` has one row per (``by``, ``bucket``). Two levels of windows keep each sorted
    group at ``block`` rows or at the number of blocks, so no task sees all buckets.
    """
    from pyspark.sql import Window

    c = counts.withColumn("_block", F.floor(F.col(bucket) / F.lit(block)))
    totals = c.groupBy(*by, "_block").agg(F.sum(count).alias("_total"))
    up_to = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(up_to), F.lit(0)))
    within = Window.partitionBy(*by, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    inner = c.withColumn("_in", F.coalesce(F.sum(count).over(within), F.lit(0)))
    same = F.col("i._block") == F.col("t._block")
    for k in by:
        same &= F.col(f"i.{k}").eqNullSafe(F.col(f"t.{k}"))
    return inner.alias("i").join(totals.alias("t"), same).select(
        *[F.col(f"i.{k}") for k in by], F.col(f"i.{bucket}"), F.col(f"i.{count}"),
        (F.col("_base") + F.col("_in")).cast("long").alias("before"))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")
