import hashlib
import random
import zlib
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import runs


def brute(w, least=6, exponent=4):
    """All runs by trying every period at every place."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q))
            if length >= max(least, exponent * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(6, 4), (3, 2), (4, 3), (6, 2)]))
def test_small_alphabets_equal_brute_force(w, limits):
    assert runs.runs_of(w, *limits) == brute(w, *limits)


def test_periodic_texts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        w = []
        while len(w) < rng.randint(0, 150):
            block = [rng.randrange(rng.choice((1, 2, 5, 40))) for _ in range(rng.randint(1, 9))]
            w += block * rng.randint(1, 7) + block[: rng.randrange(len(block))]
        assert runs.runs_of(w) == brute(w)
        assert runs.runs_of(w, 3, 2) == brute(w, 3, 2)


@pytest.mark.parametrize("prime,base", [(5, 2), (2, 1)])
def test_false_equalities_of_hashes_are_found_out(monkeypatch, prime, base):
    monkeypatch.setattr(runs, "_PRIME", prime)
    monkeypatch.setattr(runs, "_BASE", base)
    rng = random.Random(prime)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(0, 50))]
        assert runs.runs_of(w, 3, 2) == brute(w, 3, 2)


def test_long_texts_take_time_in_proportion():
    import time

    rng = random.Random(1)
    block = [rng.randrange(50) for _ in range(500)]
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 200_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    begin = time.perf_counter()
    assert runs.runs_of(["a"] * 300_000) == [(0, 300_000, 1)]
    assert runs.runs_of(block * 600) == [(0, 300_000, 500)]
    assert runs.runs_of([0, 1] * 100_000 + [2] + [0, 1] * 100_000) == [(0, 200_000, 2), (200_001, 200_000, 2)]
    assert runs.runs_of(fibonacci[-1][:200_000]) == []  # its exponents stay under 3.7
    assert time.perf_counter() - begin < 60


def want(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *head, sha("".join(f"{s},{length},{p}\n" for s, length, p in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def test_query_equals_brute_force(spark, make_docs):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = [(i, t) for i, t in zip(docs["doc_id"], docs["text"]) if len(t or "") < 4000]
    rows += [(1000 + i, f"{'so it goes ' * (i % 9)}\tand  {'ha ' * i}\n{'x y ' * 4}") for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n\x0b"), (None, "a " * 8), (2003, "a b a b " * 9)]
    got = runs.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted((want(*r) for r in rows), key=key)


def test_odd_rows_and_clashing_columns(spark, odd_docs):
    from pyspark.sql import functions as F

    out = runs.periodic_runs(odd_docs.withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x")))
    rows = out.collect()
    assert len(rows) == 9 and {"lang", "source", "text", "collapsed"} <= set(out.columns)
    assert next(r for r in rows if r.doc_id == 4).collapsed == "word"
    assert [r.n_words for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert sum(r.collapsed == "same text of two rows" for r in rows) == 2
    assert runs.query(odd_docs.limit(0)).count() == 0
    assert len(runs.query(odd_docs).collect()) == 9
    with pytest.raises(ValueError):
        runs.periodic_runs(odd_docs, exponent=1)
