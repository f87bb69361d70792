import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.llm import near_dup


def _sets(texts, width):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def _brute(ids, texts, width=2, percent=80):
    """Every pair by its sets, components by repeated minimum."""
    sets = _sets(texts, width)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_size = sorted((len(s), i, s) for i, s in zip(ids, sets) if s)
    for k, (n, i, s) in enumerate(by_size):
        for n2, j, s2 in by_size[k + 1 :]:
            if 100 * n < percent * n2:
                break
            common = len(s & s2)
            if 100 * common >= percent * (n + n2 - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in zip(ids, sets)}


def _got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = pq.read_table(path).to_pydict()
    assert _got(near_dup.query(spark.read.parquet(path))) == _brute(docs["doc_id"], docs["text"])


def test_groups_chains_and_short_texts(make_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    chain = [rng.choice(words) for _ in range(100)]
    for step in range(8):  # each is near the next, the first is far from the last
        chain = chain[6:] + [rng.choice(words) for _ in range(6)]
        texts.append("\t".join(chain).upper())
    texts += ["one", "ONE", "one two", "One\ntwo ", "", None, " ", "three", "a b a b a b"]
    docs = make_docs(texts)
    assert _got(near_dup.query(docs)) == _brute(range(len(texts)), texts)
    assert _got(near_dup.near_duplicates(docs)) == _brute(range(len(texts)), texts, 5)


def test_odd_rows(odd_docs):
    rows = near_dup.query(odd_docs.withColumn("kept", F.lit(1))).collect()
    assert len(rows) == 9
    assert all(r.kept for r in rows)
    assert [r.component_id for r in rows if r.doc_id == 6] == [6, 6]
    assert [(r.component_id, r.n_shingles) for r in rows if r.doc_id is None] == [(None, 2)]
    assert near_dup.query(odd_docs.limit(0)).count() == 0


def test_partial_keys_meet_as_often_as_computed():
    import numpy as np

    rng = np.random.default_rng(5)
    family, met = near_dup._family(20, 4), 0
    for _ in range(300):
        x = near_dup._mix(rng.integers(0, 2**63, 900, dtype=np.uint64))
        a, b = np.sort(x[:800]), np.sort(x[100:900])  # 700 of 900: 0.778
        ka, kb = near_dup.partial_keys(a, family, 20, 4), near_dup.partial_keys(b, family, 20, 4)
        met += bool((ka[:20] == kb[:20]).any() and (ka[20:] == kb[20:]).any())
    assert met >= 296


def test_large_group_of_near_copies_and_long_texts(spark, monkeypatch):
    """A hot centre in many parts, blocks of few sets, and texts of very different lengths."""
    monkeypatch.setattr(near_dup, "_PART_ROWS", 7)
    monkeypatch.setattr(near_dup, "_BLOCK_SETS", 5)
    rng = random.Random(8)
    base, texts = [f"b{i}" for i in range(80)], []
    for i in range(400):
        copy = list(base)
        for _ in range(i % 12):
            copy[rng.randrange(80)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(copy))
    # They share most with the group without being near copies, and some are near to each other.
    for i in range(60):
        texts.append(" ".join(base[:60] + [f"y{i // 3}{j}" for j in range(30)] + [f"z{i}"]))
    long = [f"l{rng.randrange(5000)}" for _ in range(40_000)]
    texts += [" ".join(long), " ".join(long[:-500]), " ".join(long[:5000]), " ".join(base * 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert _got(near_dup.query(docs)) == _brute(range(len(texts)), texts)


def test_ids_that_are_no_integers(spark):
    same = "a b c d e f g h"
    docs = spark.createDataFrame([("7", same), ("9", same)], "doc_id string, text string")
    assert _got(near_dup.query(docs)) == {7: (7, 7, True), 9: (7, 7, False)}
    with pytest.raises(Exception):
        near_dup.query(docs.union(spark.createDataFrame([("x", same)], docs.schema))).collect()


def test_recall_of_links_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.82, each a component of its own: all but 1 in 10000 should be found."""
    rng, rows = random.Random(4), []
    for i in range(400):
        n = 90 + i % 60
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        # Each changed word in the middle costs two shingles of either side.
        changed, copy = 0, list(words)
        while 100 * (n - 1 - 2 * (changed + 1)) >= 80 * (n - 1 + 2 * (changed + 1)):
            copy[3 + 3 * changed] = "x"
            changed += 1
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    got = _got(near_dup.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    want = _brute([r[0] for r in rows], [r[1] for r in rows])
    assert sum(not kept for *_, kept in want.values()) == 400
    assert got == want
