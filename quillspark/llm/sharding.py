"""Proportional stratified interleaving of rows into shards.

Rows of each source are shuffled by a seeded hash and ranked; sorting all rows by their
fractional rank ``(rank - 1/2) / rows of the source`` spreads every source evenly over the
order, so that equal cuts of it have the mixture of the whole. Ranks and positions are
taken inside hash and order buckets whose sizes are summed up separately, so neither a hot
source nor the whole order is ever sorted by one task.

Wholly repeated rows are counted before they move and multiplied again once their ranks are
known, so that they do not meet in one task, either.

Defined results: a null source is a source of its own; a null elsewhere is a value like any
other (in ``query`` a null text has no bytes); repeated rows are ranked one by one; very
long texts are columns like others; an empty table gives no rows; all columns pass through,
and columns named shard or slot are replaced. Counts of shards differ by at most one. A row
is told from others by a 128-bit hash of its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import Scratch, running_offsets, utf8

_ROWS_PER_BUCKET = 2_000
_LEAST_BUCKETS = 256


def interleave(df: DataFrame, shards: int, source: str = "source", seed: int = 0) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless in each shard) to every row of ``df``."""
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    content = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *[F.struct(F.col(c).isNull(), F.col(c)) for c in kept])
    hashed = df.select(F.struct(*kept).alias("_row"), content(0).alias("_hash"), content(1).alias("_tie"), F.col(source).alias("_source"))
    # Written once: all that follows reads the same rows, whatever is run again.
    distinct = Scratch(df.sparkSession).keep(hashed.groupBy("_source", "_hash", "_tie").agg(F.first("_row").alias("_row"), F.count("*").alias("_n")))
    rows = distinct.agg(F.sum("_n")).first()[0]
    if not rows:
        return df.select(*kept, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    buckets = max(_LEAST_BUCKETS, -(-rows // _ROWS_PER_BUCKET))
    bucket_of = lambda unit: F.least(F.floor(unit * buckets), F.lit(buckets - 1)).cast("int")

    def before(n: Column | str, by: list[str], order: list[str]) -> Column:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(w), F.lit(0))

    # The upper bits order the rows, so the bucket is a prefix of the order.
    hashed = distinct.withColumn("_bucket", bucket_of((F.col("_hash").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)))
    sizes = hashed.groupBy("_source", "_bucket").agg(F.sum("_n").alias("_n"))
    totals = sizes.groupBy("_source").agg(F.sum("_n").alias("_total"))
    offsets = running_offsets(sizes, "_bucket", "_n", ["_source"])
    offsets = offsets.alias("o").join(totals.alias("t"), F.col("o._source").eqNullSafe(F.col("t._source"))).select("o._source", "o._bucket", "before", "_total")
    ranked = hashed.withColumn("_nth", before("_n", ["_source", "_bucket"], ["_hash", "_tie"])).alias("r").join(
        offsets.alias("o"), F.col("r._source").eqNullSafe(F.col("o._source")) & (F.col("r._bucket") == F.col("o._bucket")))
    ranked = ranked.select("_row", "r._source", "_hash", "_tie", "_total", (F.col("before") + F.col("_nth")).alias("_first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy"))
    ranked = ranked.withColumn("_at", (F.col("_first") + F.col("_copy") + F.lit(0.5)) / F.col("_total"))
    ranked = ranked.select("_row", "_source", "_hash", "_tie", "_copy", "_at", bucket_of(F.col("_at")).alias("_bucket"))
    order = running_offsets(ranked.groupBy("_bucket").agg(F.count("*").alias("_n")), "_bucket", "_n", [])
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("_at", "_source", "_hash", "_tie", "_copy"))
    placed = ranked.withColumn("_nth", nth).join(order.select("_bucket", "before"), "_bucket")
    placed = placed.withColumn("_pos", F.col("before") + F.col("_nth") - 1)
    # Shard s has the positions from ceil(s * rows / shards) on.
    shard = F.expr(f"cast((_pos * {shards}L) div {rows}L as int)")
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select("_row.*", "shard", (F.col("_pos") - first).alias("slot"))


def query(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Sizes and checksums stand for the texts, which need not move to be placed."""
    light = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(utf8(F.coalesce("text", F.lit("")))).alias("text_crc32"))
    out = interleave(light, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
