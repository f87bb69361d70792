"""Steps whose memory in one task must not grow with the table."""

from pyspark.sql import functions as F

from quillspark.functions.analysis import LETTERS
from quillspark.operators import index, validation
from quillspark.sources import files
from quillspark.streaming import segments

TEXTS = [(1, "a b a c"), (2, ""), (3, None), (4, "b b"), (4, "b c"), (None, "z")]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_text_by_text(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    words = index.counted_words(docs, LETTERS)
    assert "HashAggregate" not in _plan(words)
    assert sorted(map(tuple, words.where("doc_id < 4").collect()), key=str) == [
        ("a", 1, 2, 4, False), ("b", 1, 1, 4, False), ("c", 1, 1, 4, False), (None, 2, 1, 0, False), (None, 3, 1, 1, True)]


def test_ids_that_come_again_are_added_up(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    want = {("a", 1, 2), ("b", 1, 1), ("c", 1, 1), ("b", 4, 3), ("c", 4, 1), ("z", None, 1)}
    counted = index.count_postings(docs, LETTERS)
    assert sorted(counted.select("term", "doc_id", "tf").collect(), key=str) == sorted(want, key=str)
    assert "HashAggregate" not in _plan(index.count_postings(docs.where("doc_id < 4"), LETTERS))
    built = index.build_index(docs, LETTERS).write(f"{tmp_path}/i")
    assert {tuple(r) for r in built.postings.select("term", "doc_id", "tf").collect()} == want and built.postings.count() == len(want)


def test_ranges_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(index, "RANGE_ROWS", 100)
    rows = spark.range(5000).select(F.lit("the").alias("term"), F.col("id").alias("doc_id"), F.lit(1).alias("tf"), F.lit(1).alias("dl"))
    ranged = index.by_range(rows, 5000, "term", "doc_id")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 400
    assert index._added_up(ranged).count() == 5000


def test_a_frequent_term_is_in_many_files_of_a_segment(spark, tmp_path):
    rows = spark.range(0, 200_000).select(F.lit("the").alias("term"), F.col("id").alias("doc_id"), F.lit(1).alias("tf"), F.lit(1).alias("dl"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would make one of small ranges
    try:
        files.write_segment(rows, f"{tmp_path}/s")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 200_000 and len(back.inputFiles()) > 1


def test_latest_batches_are_not_merged_again(spark, tmp_path):
    path = f"{tmp_path}/s"
    for n, text in enumerate(("a a b", "a")):
        docs = spark.createDataFrame([(1, text), (n + 2, "c")], "doc_id long, text string")
        index.count_postings(docs, LETTERS).write.parquet(f"{path}/postings/batch={n}")
        index.document_lengths(docs, LETTERS).write.parquet(f"{path}/doc_stats/batch={n}")
    read = segments.read_segments(spark, path, LETTERS)
    assert {tuple(r) for r in read.postings.select("term", "doc_id", "tf").collect()} == {("a", 1, 1), ("c", 2, 1), ("c", 3, 1)}
    assert "keys=[term" not in _plan(read.postings)


def test_layouts_are_timed_without_collecting(spark, monkeypatch):
    frame = type(spark.range(1))
    layouts = {"one": lambda q: spark.range(10), "two": lambda q: spark.range(10)}
    taken = []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: taken.append(1) or collect(self))
    report = validation.compare_layouts(layouts, ["x"], spark)
    assert not taken and {r.layout for r in report.collect()} == {"one", "two"}


def test_blocks_of_one_long_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b " * 60), (2, "c a")], "doc_id long, text string")
    got = sorted(map(tuple, index.cut_blocks(docs, LETTERS, 49, f"{tmp_path}/b").collect()))
    assert got == [(0, "a", 1, 25), (0, "b", 1, 25), (1, "a", 1, 25), (1, "b", 1, 25), (2, "a", 1, 10), (2, "a", 2, 1), (2, "b", 1, 10), (2, "c", 2, 1)]
