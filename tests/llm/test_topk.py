import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import topk


def _brute(ids, vectors, is_query, k):
    q = [(i, np.floor(256 * np.asarray(v, float)).astype(np.int64)) for i, v in zip(ids, vectors)]
    out = set()
    for i, v in q:
        if is_query(i):
            best = sorted((-int(v @ w), j) for j, w in q if j != i)[:k]
            out |= {(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("blocks", [8192, 37])
def test_equals_brute_force_with_many_ties(spark, blocks):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-3, 4, (400, 6)) / 2.0
    vectors[50:150] = vectors[0]
    vectors[rng.random(vectors.shape) < 0.3] = 0
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, candidate_rows=blocks, query_rows=3).collect()
    assert {tuple(r) for r in got} == _brute(range(400), vectors, lambda i: i % 50 == 0, 5)


def _exact(rows, k=5, scale=256):
    """Every query row against all others in Python's integers."""
    from fractions import Fraction
    from math import floor

    able = [(i, [floor(Fraction(x) * scale) for x in v]) for i, v in rows]
    out = []
    for i, v in {(i, tuple(v)): (i, v) for i, v in able}.values():
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in able if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size", [3e5, 1e10, 1e18, 3e38, 1e300])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.uniform(-size, size, 3)]) for i in range(120)]
    rows += [(200, [0.5, 1.0, -0.25]), (201, [size, size, -size]), (202, [size, size, -size])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for blocks in (8192, 25):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, candidate_rows=blocks).collect()
        assert sorted(tuple(r) for r in got) == _exact(rows)


def test_repeated_query_ids_are_queries_of_their_own(spark):
    rows = [(0, [1.0]), (0, [-1.0]), (0, [-1.0]), (1, [1.0]), (2, [2.0]), (3, [-3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own")).withColumn("rank", F.lit(None))
    got = sorted(tuple(r) for r in topk.query(df).collect())
    assert got == sorted([(0, 1, 2, 131072), (0, 2, 1, 65536), (0, 3, 3, -196608), (0, 1, 3, 196608), (0, 2, 1, -65536), (0, 3, 2, -131072)])
    assert got == _exact(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (6, [1.0, -1.0]), (6, [1.0, -1.0]), (50, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.query(df).collect()]
    assert sorted(got) == [(0, 1, 6, -65536), (0, 2, 6, -65536)]
    assert topk.query(df.limit(0)).count() == 0
