"""Joins with a table of one row per key, when some keys have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 64  # characters of a key that is broadcast


def least_frequent(counts: DataFrame, n: str, most: int) -> int:
    """A power of two that at most ``most`` of the counts ``n`` reach; 1 if all do not exceed that number.

    Only a histogram of the counts' bits comes to the driver.
    """
    bits = {r["bit"]: r["count"] for r in counts.groupBy(F.length(F.bin(n)).alias("bit")).count().collect()}
    bit, left = max(bits, default=0) + 1, most
    while bit > 1 and bits.get(bit - 1, 0) <= left:
        bit -= 1
        left -= bits.get(bit, 0)
    return 1 << bit - 1


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, most: int = 10_000) -> DataFrame:
    """``rows`` inner joined by ``key``, a string, with ``table``, whose ``n`` tells how many rows have the key.

    The most frequent keys, at most ``most`` of at most ``LONGEST`` characters each, are
    broadcast, so their rows stay where they are. Only the others move, and none of them is
    as frequent. ``table`` is read several times: it should be written.
    """
    short = F.length(key) <= LONGEST
    least = least_frequent(table.where(short), n, most)
    head = F.broadcast(table.where(short & (F.col(n) >= least)).drop(n))
    found = rows.join(head, key)
    rest = rows.join(head.select(key), key, "left_anti").join(table.where(~(short & (F.col(n) >= least))).drop(n), key)
    return found.unionByName(rest)
