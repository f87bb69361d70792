import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.analysis import LETTERS, LETTERS_PORTER
from quillspark.operators import index, skew
from quillspark.operators.levels import SegmentStore


def _frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def _same(store, spark, docs):
    got, want = store.index(), index.build_index(_frame(spark, docs), store.analyzer)
    for name in ("postings", "term_stats", "doc_stats"):
        a, b = getattr(got, name), getattr(want, name)
        b = b.select(*a.columns)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())), name
    assert got.corpus == want.corpus


@pytest.mark.parametrize("marks", [1_000_000, 0])
def test_adds_replacements_and_deletions(spark, tmp_path, marks):
    rng = random.Random(3)
    store = SegmentStore(spark, f"{tmp_path}/s", f"levels_{marks}", LETTERS_PORTER, buckets=4, marks=marks)
    docs: dict[int, str | None] = {}
    _same(store, spark, docs)
    for step in range(4):
        new = {rng.randrange(40): rng.choice([None, "", " ".join(rng.choices(["running", "runs", "cat", "Cats", "dog"], k=rng.randint(1, 9)))]) for _ in range(12)}
        store.add(_frame(spark, new))
        docs |= new
        if step % 2:
            gone = rng.sample(sorted(docs), 5) + [999]
            store.delete(spark.createDataFrame([(i,) for i in gone + gone[:1]], "doc_id long"))
            docs = {i: t for i, t in docs.items() if i not in gone}
        if step == 2:
            _same(store, spark, docs)
            store.merge(3)
        _same(store, spark, docs)
    assert [x for _, x in store.segments()] == sorted((x for _, x in store.segments()), reverse=True)
    store.merge(2)
    _same(store, spark, docs)
    # Another session finds the same.
    _same(SegmentStore(spark, f"{tmp_path}/s", f"again_{marks}", LETTERS_PORTER, buckets=4, marks=marks), spark, docs)
    store.compact()
    assert len(store.segments()) == 1
    _same(store, spark, docs)


def test_what_a_lost_job_left_is_not_read(spark, tmp_path):
    store = SegmentStore(spark, f"{tmp_path}/s", "levels_lost", LETTERS, buckets=4)
    store.add(_frame(spark, {1: "a b"}))
    store._write_postings(index.count_postings(_frame(spark, {2: "c"}), LETTERS), store._next())
    _same(store, spark, {1: "a b"})


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_do_not_move(spark, tmp_path):
    store = SegmentStore(spark, f"{tmp_path}/s", "levels_plan", LETTERS, buckets=4)
    for k in range(3):
        store.add(_frame(spark, {i: f"word{i % 7} common" for i in range(10 * k, 10 * k + 20)}))
    store.delete(spark.createDataFrame([(3,)], "doc_id long"))
    found = store.index()
    for df in (found.term_stats, found.postings):
        assert "hashpartitioning(term" not in _plan(df) and "rangepartitioning" not in _plan(df)
    assert {r.term: r.df for r in found.term_stats.collect()}["common"] == 39


def test_rows_of_frequent_words_stay(spark, tmp_path):
    rows = [(f"w{i % 3000}", i) for i in range(30_000)] + [("every", i) for i in range(60_000)] + [("x" * 100, i) for i in range(9)]
    words = spark.createDataFrame(rows, "word string, doc_id long").repartition(16)
    words.write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    table = words.groupBy("word").agg(F.count("*").alias("n")).withColumn("term", F.upper("word"))
    table.write.parquet(f"{tmp_path}/table")
    table = spark.read.parquet(f"{tmp_path}/table")
    assert skew.least_frequent(table, "n", 5) > 10 and skew.least_frequent(table, "n", 10_000) == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for most in (1, 100, 10_000):
            joined = skew.join_counted(words, table, "word", "n", most)
            assert joined.count() == len(rows) and joined.where("term <> upper(word)").count() == 0
            sizes = sorted(r["count"] for r in joined.where("word = 'every'").groupBy(F.spark_partition_id()).count().collect())
            assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
