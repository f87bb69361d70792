import time

import __spark_entry__ as e
from pyspark.sql import functions as F

from quillspark.operators import codec

DIR = "/root/testdata/sf0.01"


def test_long_list_is_decoded_in_one_pass(spark):
    n = 300_000
    ids = spark.range(1).select(F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string"))).alias("ids"))
    begin = time.perf_counter()
    r = ids.select(codec.decode_postings(codec.encode_postings(F.col("ids"))).alias("b"), "ids").select((F.col("b") == F.col("ids")).alias("same"), F.size("b").alias("n")).first()
    assert (r.same, r.n) == (True, n)
    assert time.perf_counter() - begin < 30


def test_odd_lists(spark):
    rows = spark.createDataFrame([([],), (["", "é", "日本.txt"],), (None,)], "ids array<string>").coalesce(1)
    got = rows.select("ids", codec.decode_postings(codec.encode_postings(F.col("ids"))).alias("b")).collect()
    assert [r.b for r in got][:2] == [[], ["", "é", "日本.txt"]]


def test_every_term_goes_through_the_codec(spark):
    got, want = (e.queries()[n](spark, DIR) for n in ("codec_round_trip", "inverted_index"))
    assert got.where(F.size(F.split("postings", ", ")) > 100).count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_every_term_has_the_id_of_its_offset(spark):
    got, want = e.queries()["term_ids"](spark, DIR), e.queries()["term_offsets"](spark, DIR).select("term", "term_id")
    assert got.count() == e.queries()["term_df"](spark, DIR).count()
    assert got.exceptAll(want).isEmpty()


def test_a_frequent_term_has_many_parts(spark):
    from quillspark.operators import index

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        postings = spark.range(20_000).selectExpr("if(id % 10 = 0, concat('t', id), 'hot') as term", "id as doc_id", "1L as tf", "1L as dl")
        chunks = codec.encoded_chunks(postings)
        assert chunks.where("term = 'hot'").count() > 3
        got = codec.decode_chunks(chunks)
        want = postings.selectExpr("term", "cast(doc_id as string) as doc_id")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        ids = index.inverted_lists(postings).where("term = 'hot'").first().postings
        assert ids == sorted(str(i) for i in range(20_000) if i % 10)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_blocks_are_truly_cut(spark, tmp_path):
    from quillspark.functions.analysis import LETTERS
    from quillspark.operators import index

    docs = spark.createDataFrame([(i, " ".join("abc"[(i + k) % 3] * (k % 4 + 1) for k in range(i % 40))) for i in range(200)] + [(900, None)], "doc_id long, text string").repartition(7)
    blocks = index.cut_blocks(docs, LETTERS, 99, f"{tmp_path}/blocks")
    sizes = {r.block: r for r in index.block_sizes(blocks).collect()}
    tokens = index.count_postings(docs, LETTERS).agg({"tf": "sum"}).first()[0]
    assert sorted(sizes) == list(range(-(-tokens // 100))) and sum(r.n_tokens for r in sizes.values()) == tokens
    assert all(r.n_tokens == 100 for b, r in sizes.items() if b < max(sizes)) and min(r.n_bytes for r in sizes.values()) > 0
    merged = blocks.groupBy("term", "doc_id").agg({"tf": "sum"}).collect()
    assert sorted(map(tuple, merged)) == sorted((r.term, r.doc_id, r.tf) for r in index.count_postings(docs, LETTERS).collect())
    lines: dict = {}
    for r in blocks.orderBy("block", "term").collect():
        lines.setdefault(r.block, {}).setdefault(r.term, []).append(str(r.doc_id))
    assert {b: sum(len(f"{t}: {', '.join(i)}\n") for t, i in x.items()) for b, x in lines.items()} == {b: r.n_bytes for b, r in sizes.items()}
