"""Sums over all smaller rows of a global order, without one task sorting all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.stored import shared_folder


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add a column for each name of ``sums``: the sum of its column over all smaller rows.

    ``order`` must tell rows apart. Ranges of the order are written once with their number,
    so that what is summed up per range and within it are the same rows; the only window
    over everything has one row per range.
    """
    spark, path = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/ranges"
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    written = spark.read.schema(ranged.schema).parquet(path)
    all_, own = Window.orderBy("_range"), Window.partitionBy("_range").orderBy(*order)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    totals = written.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    bases = totals.select("_range", *[before(f"_{name}", all_).alias(f"_{name}") for name in sums])
    inner = written.select("*", *[before(c, own).alias(f"_in_{name}") for name, c in sums.items()])
    return inner.join(bases, "_range").select(*rows.columns, *[(F.col(f"_{name}") + F.col(f"_in_{name}")).alias(name) for name in sums])
