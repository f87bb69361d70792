import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.analysis import LETTERS
from quillspark.operators import pruned, ranking
from quillspark.operators.index import build_index
from quillspark.plans import boolean

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    """6000 documents of 1 to 400 words, words of Zipf frequencies, equal scores and copies among them."""
    rng = random.Random(4)
    words = [c * n for n in (1, 2, 3) for c in ALPHABET]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice((1, 3, 20, 80, 400)))) for _ in range(5900)]
    docs = [(i, t) for i, t in enumerate(texts + texts[:90] + ["", "z" * 9, "a a a a a b b b"] + ["zz"] * 7)]
    root = tmp_path_factory.mktemp("blocks")
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"), LETTERS).write(f"{root}/index")
    return pruned.build_blocks(index, 32).write(f"{root}/blocks")


def test_blocks_hold_the_postings(blocks):
    rows = blocks.blocks.select("term", F.explode("postings").alias("p")).select("term", "p.*")
    own = blocks.index.postings.select("term", "doc_id", "tf", "dl")
    assert rows.exceptAll(own).count() == own.exceptAll(rows).count() == 0
    assert blocks.blocks.agg(F.max("n")).first()[0] < 150
    wrong = blocks.blocks.where("n <> size(postings) or max_tf <> array_max(postings.tf) or min_dl <> array_min(postings.dl)")
    assert wrong.count() == 0


QUERIES = ["a", "a AND b", "a OR zz OR ccc", "a AND NOT b", "(a OR b) AND (c OR ccc)", "zzz AND yyy AND xxx", "a AND a AND b", "nosuchword", "nosuchword OR a", "nosuchword AND a", "NOT a", "a OR NOT b", "zzzzzzzzz"]


@pytest.mark.parametrize("text,method", [*((q, m) for q in QUERIES for m in ("bm25", "tfidf")), ("a AND b", "vector"), ("NOT a", "vector"), ("a", "none")])
def test_equals_scoring_all(blocks, text, method):
    query = boolean.parse(text, LETTERS)
    for k in (1, 10):
        want = ranking.top(ranking.search(blocks.index, query, method), k).collect()
        got = pruned.pruned_top(blocks, query, k, method).rows.collect()
        assert [(r.rank, r.doc_id, round(r.score, 9)) for r in got] == [(r.rank, r.doc_id, round(r.score, 9)) for r in want]


@pytest.mark.parametrize("listed", [0, 3])
def test_neighbourhoods_beyond_the_list_are_joined(blocks, monkeypatch, listed):
    monkeypatch.setattr(pruned, "_LISTED", listed)
    query = boolean.parse("a AND b", LETTERS)
    got = pruned.pruned_top(blocks, query, 50)
    assert got.rows.collect() == ranking.top(ranking.search(blocks.index, query, "bm25"), 50).collect()


@pytest.mark.parametrize("text,most", [("a", 0.3), ("b", 0.3), ("a AND b", 0.5), ("a OR b OR c", 0.6)])
def test_reads_a_part_of_the_postings(blocks, text, most):
    df = blocks.index.document_frequencies(["a", "b", "c"])
    got = pruned.pruned_top(blocks, boolean.parse(text, LETTERS), 10)
    every = sum(n for t, n in df.items() if t in text.lower().split())
    assert got.of == every and got.read < most * every, (got.read, every)


def test_bounds_read_no_postings(blocks):
    plan = pruned.bounds(blocks, boolean.parse("a AND b", LETTERS), "bm25")._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan.split("ReadSchema")[1].split("\n")[0] and "In(term, [a,b])" in plan
