import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid


def _brute_trees(train, order, least):
    """Context dictionaries of one language: counts of every string, then the nodes."""
    n = Counter()
    for t in train:
        b = b" " * (2 * order) + t.encode()
        for i in range(order, len(b)):
            if t:
                for length in range(1, order + 2):
                    n[b[i - length + 1 : i + 1]] += 1
    trees = {}
    for gram, c in n.items():
        if len(gram) == 1 or n[gram[:-1]] >= least:
            trees.setdefault(gram[:-1], {})[gram[-1]] = c
    return trees


def _brute_bits(trees, text, order):
    b, total = b" " * order + text.encode(), 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            successors = trees.get(b[i - k : i])
            if not successors:
                continue
            n, d = sum(successors.values()), len(successors)
            if b[i] in successors:
                total -= math.log2(successors[b[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


TRAIN = {"x": ["the cat sat on the mat. é", "a b", "the the then 12", ""], "y": ["der Hut steht gut", "the Ä der die das der die das", "ßß 99"]}
TEXTS = ["the cat", "", "zq then é", "\x00\x7f", "a", "the mat and the cat " * 30, "der Hut  steht", "日本", " "]


@pytest.mark.parametrize("least", [1, 2, 5])
@pytest.mark.parametrize("order", [1, 4])
def test_code_lengths_equal_explicit_trees(spark, least, order):
    df = spark.createDataFrame([(t, i) for i, ts in enumerate(TRAIN.values()) for t in ts], "text string, lang int").repartition(3)
    nodes = langid._nodes(df, order, least).toPandas()
    grams = {k: tuple(g[c].to_numpy() for c in ("code", "lang", "n")) for k, g in nodes.groupby("length")}
    scorer = langid.Scorer(langid.build(list(TRAIN), grams, order))
    want = np.asarray([[_brute_bits(_brute_trees(ts, order, least), t, order) for ts in TRAIN.values()] for t in TEXTS])
    for chunk in (langid._CHUNK, 7):
        langid._CHUNK, old = chunk, langid._CHUNK
        got = scorer.bits([t.encode() for t in TEXTS])
        langid._CHUNK = old
        assert got == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_whole_query_equals_brute_force(spark, make_docs):
    """Trees, temperature and prediction of the query on a small table, text by text."""
    texts = [f"{w} {w}s the {i}" for i in range(60) for w in ("cat",)] + [f"der {w} und {i}" for i in range(60) for w in ("Hut",)] + [None, "", "12", "the cat", "der Hut"]
    docs = make_docs(texts, ["en"] * 60 + ["de"] * 60 + ["en"] * 3 + [None, None])
    model = langid.learn(docs, rows_per_language=10**6)
    apart = {r.doc_id for r in docs.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(8)) == 0).collect()}
    rows = [r for r in docs.collect() if r.text is not None and r.lang is not None]
    trees = {k: _brute_trees([r.text for r in rows if r.lang == k and r.doc_id not in apart], 4, 4) for k in ("de", "en")}
    for r in langid.predict(docs, model).collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        bits = {k: _brute_bits(t, r.text, 4) for k, t in trees.items()}
        assert r.lang_pred == min(bits, key=lambda k: (round(bits[k], 3), k))
        assert r.score == pytest.approx(1 / sum(2 ** ((min(bits.values()) - b) / model.temperature) for b in bits.values()), abs=1e-4)


def test_fewer_nodes_when_room_is_short(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    full, small = langid.learn(docs), langid.learn(docs, model_bytes=1 << 18)
    assert len(small.cost) < len(full.cost) / 4
    assert sum(x.nbytes for x in (small.slots, small.child, small.cost, small.escape)) <= (1 << 18) + 256 * 64 * 8
    with pytest.raises(ValueError):
        langid.learn(docs, most_languages=3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held, right = got.where("held_out").select(F.count("*"), F.count(F.when(F.col("lang") == F.col("lang_pred"), 1))).first()
    assert held > 200 and right / held >= 0.98
    assert got.where("score < 0 or score > 1").count() == 0
    crc = docs.where("crc32(encode(cast(doc_id as string), 'UTF-8')) % 4 = 2").count()
    assert crc == held


def test_odd_rows(odd_docs, make_docs):
    rows = langid.query(odd_docs).collect()
    assert len(rows) == 9
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0
    assert by_id[None].held_out is False
    assert langid.query(odd_docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.query(make_docs(["text one", "two"], [None, None])).collect()} == {"und"}
    out = langid.predict(odd_docs.withColumn("score", F.lit("x")), langid.fit(odd_docs))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]


def test_hash_table_finds_all_and_only_its_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 32, 5000))
    slots, child = langid._table(keys, np.arange(1, len(keys) + 1))
    none = np.zeros((1, 0))
    scorer = langid.Scorer(langid.Model([], 1, np.zeros(256, np.int32), np.zeros(1 << 16, np.int32), slots, child, none, none))
    others = np.setdiff1d(rng.integers(1, 1 << 32, 5000), keys)
    assert (scorer._children(keys.astype(np.uint32)) == np.arange(1, len(keys) + 1)).all() and not scorer._children(others.astype(np.uint32)).any()
