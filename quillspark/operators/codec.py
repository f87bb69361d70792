"""The compact binary form of an index: dictionary string, term offsets, encoded postings.

A term's postings are a big-endian 32-bit count, then for each id in string order a 32-bit
length and its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.index import by_range, inverted_lists
from quillspark.operators.running import running_sums
from quillspark.operators.stored import shared_folder
from quillspark.sources.binary import sorted_runs

ENTRY_BYTES = 12  # of a term in the offset table
_BARE = {"term": pa.string(), "part": pa.int32(), "place": pa.int64(), "n": pa.int64(), "before": pa.int64(), "size": pa.int64(), "data": pa.binary()}


def _entries(ids: Column) -> Column:
    """Hex digits of the entries of an array of id strings."""
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lpad(F.hex(F.octet_length(x).cast("long")), 8, "0"), F.hex(F.encode(x, "UTF-8")))), "")


def encode_postings(ids: Column) -> Column:
    """BINARY of an array of id strings in string order."""
    return F.unhex(F.concat(F.lpad(F.hex(F.size(ids).cast("long")), 8, "0"), _entries(ids)))


def _ids_of(data: bytes, at: int = 4) -> list[str]:
    out = []
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        out.append(data[at + 4 : end].decode("utf-8", "replace"))
        at = end
    return out


def _decoded(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _ids_of(x) for x in data.to_pylist()], pa.list_(pa.string()))


def decode_postings(data: Column) -> Column:
    """The id strings of an encoded list, in one pass: where a length stands depends on all
    before it, and built-in functions would copy what they have gathered at every step."""
    return F.arrow_udf(_decoded, "array<string>")(data)


def _decoded_part(data: pa.Array, first: pa.Array) -> pa.Array:
    return pa.array([_ids_of(x, 4 if f else 0) for x, f in zip(data.to_pylist(), first.to_pylist())], pa.list_(pa.string()))


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """(term, doc_id) of ``encoded_chunks``; no row moves."""
    ids = F.arrow_udf(_decoded_part, "array<string>")(F.col("data"), F.col("first"))
    return chunks.select("term", F.explode(ids).alias("doc_id"))


def term_table(postings: DataFrame) -> DataFrame:
    """(term, term_id, start, len, offset, df): where a term stands in the dictionary string and its list in the bytes.

    Only counts and lengths are read; no list is made.
    """
    ids = F.octet_length(F.col("doc_id").cast("string"))
    sizes = postings.groupBy("term").agg(F.count("*").alias("df"), (F.sum(ids + 4) + 4).cast("long").alias("bytes"))
    sized = sizes.withColumn("len", F.length("term").cast("int")).withColumn("one", F.lit(1).cast("long"))
    return running_sums(sized, ["term"], {"term_id": "one", "start": "len", "offset": "bytes"}).select("term", "term_id", "start", "len", "offset", "df")


def dictionary_string(postings: DataFrame) -> DataFrame:
    """(start, text): the dictionary string, all terms in order end to end, in pieces of at most 10000 terms."""
    pieces = term_table(postings).withColumn("piece", F.expr("term_id div 10000L"))
    joined = pieces.groupBy("piece").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("term_id", "term"))).alias("terms"))
    return joined.select("start", F.array_join(F.col("terms.term"), "").alias("text"))


def encoded_index(postings: DataFrame) -> DataFrame:
    """(term, term_id, start, len, offset, data), a term's encoded list in one row."""
    lists = inverted_lists(postings).select("term", encode_postings(F.col("postings")).alias("data"))
    return term_table(postings).drop("df").join(lists, "term")


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a range of sorted (term, id, part): its entries, and how many bytes lie before them in the range."""
    part, rows, held, before, place = None, [], 0, 0, 0

    def ranges() -> Iterator[pa.RecordBatch]:
        nonlocal part
        for b in batches:
            if b.num_rows:
                part = b.column(2)[0].as_py()
                yield b

    def taken() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, k), v in zip(_BARE.items(), zip(*rows))})

    for term, runs in groupby(sorted_runs(ranges(), 8192), lambda r: r[0]):
        data, n, last = bytearray(), 0, None
        for _, ids in runs:
            for i in ids:
                if i != last:
                    raw = i.encode()
                    data += len(raw).to_bytes(4, "big") + raw
                    n, last = n + 1, i
        rows.append((term, part, place, n, before, len(data), bytes(data)))
        before, place, held = before + 4 + len(data), place + 1, held + len(data)
        if len(rows) >= 4096 or held >= 1 << 20:
            yield taken()
            rows, held = [], 0
    if rows:
        yield taken()


def encoded_chunks(postings: DataFrame) -> DataFrame:
    """(term, part, offset, data, first): the same bytes at the same places, a frequent term's in many rows.

    A term's first part begins with its count. Parts are ranges of (term, id), each encoded
    where it is sorted and written once; where one begins, and the count of a term that goes
    on in the next, come from a table of one row per range, so no bytes move again.
    """
    spark, path = postings.sparkSession, f"{shared_folder(postings.sparkSession)}/parts"
    ids = postings.select("term", F.col("doc_id").cast("string").alias("id"))
    ranged = by_range(ids, ids.count(), "term", "id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("term", "id")
    bare = ranged.mapInArrow(_encoded, "term string, part int, place long, n long, before long, size long, data binary")
    bare.write.parquet(path)
    bare = spark.read.schema(bare.schema).parquet(path)
    ranges = bare.groupBy("part").agg(
        F.sum(F.col("size") + 4).alias("bytes"), F.max("place").alias("last_place"), F.max_by("term", "place").alias("last_term"),
        F.min_by("term", "place").alias("first_term"), F.min_by("n", "place").alias("first_n"))
    order = Window.orderBy("part")
    ranges = ranges.withColumn("goes_on", F.coalesce(F.col("first_term") == F.lag("last_term").over(order), F.lit(False)))
    own = F.col("bytes") - F.when(F.col("goes_on"), 4).otherwise(0)
    based = ranges.withColumn("base", F.coalesce(F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    more = ranges.where("goes_on").groupBy(F.col("first_term").alias("last_term")).agg(F.sum("first_n").alias("more"))
    table = based.join(more, "last_term", "left").select("part", "base", "goes_on", "last_place", "more")
    rows = bare.join(F.broadcast(table), "part")
    first = ~(F.col("goes_on") & (F.col("place") == 0))
    df = F.col("n") + F.when(F.col("place") == F.col("last_place"), F.coalesce("more", F.lit(0))).otherwise(0)
    data = F.when(first, F.concat(F.unhex(F.lpad(F.hex(df), 8, "0")), "data")).otherwise(F.col("data"))
    offset = F.col("base") + F.col("before") - F.when(F.col("goes_on") & (F.col("place") > 0), 4).otherwise(0)
    return rows.select("term", "part", offset.cast("long").alias("offset"), data.alias("data"), first.alias("first"))


def size_report(postings: DataFrame) -> DataFrame:
    """original_size, compressed_size and ratio: compressed is larger by 16 bytes a term and 4 a posting."""
    ids = F.col("doc_id").cast("string")
    per_term = postings.groupBy("term").agg(F.sum(F.length(ids)).alias("chars"), F.sum(F.octet_length(ids) + 4).alias("data"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sizes = per_term.agg(total(F.length("term") + F.col("chars")).alias("original_size"), total(F.length("term") + ENTRY_BYTES + 4 + F.col("data")).alias("compressed_size"))
    ratio = F.when(F.col("compressed_size") > 0, F.col("original_size") / F.col("compressed_size")).otherwise(F.lit(0.0))
    return sizes.withColumn("ratio", ratio)
