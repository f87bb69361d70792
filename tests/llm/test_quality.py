import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillspark.llm import quality


def _brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def _measures(text):
    """The measures of the rules, counted by other means."""
    import unicodedata

    n_words, word_chars, n_symbols, n_dup, n_repeat = _brute(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n_lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    share = lambda a, b: 1000 * a // max(b, 1)
    return {
        "n_words": n_words, "symbols_per_1000_chars": share(n_symbols, word_chars),
        "upper_per_1000_chars": share(sum(unicodedata.category(c) == "Lu" for c in text), word_chars),
        "shouts_per_1000_words": share(sum(c in "!?" for c in text), n_words),
        "digits_per_1000_chars": share(sum(c in "0123456789" for c in text), word_chars),
        "dup_per_1000_lines": share(n_dup, n_lines), "repeated_per_1000_words": share(n_repeat, n_words),
        "distinct_per_1000_words": share(len(set(words)), n_words), "chars_per_1000_words": share(word_chars, n_words),
    }


def _verdicts_follow_the_rules(spark, d, docs, rows):
    rules = quality.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert rules and rules == quality.learn(spark.read.parquet(f"{d}/documents.parquet").repartition(7), spark.read.parquet(f"{d}/labels.parquet").repartition(3))
    for i, text in zip(docs["doc_id"], docs["text"]):
        m = _measures(text)
        hit = any(all(m[x.measure] >= x.threshold if x.above else m[x.measure] <= x.threshold for x in rule) for rule in rules)
        assert rows[i].kept == (not rows[i].base_failed and not hit), i


def test_conflicting_labels_teach_nothing(spark, make_docs):
    docs = make_docs([f"good words {' '.join(f'w{i}{j}' for j in range(30))}" for i in range(60)])
    labels = spark.createDataFrame([(i, q, 0) for i in range(60) for q in (0, 1)], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, labels) == []


def test_whole_table_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{d}/documents.parquet").to_pydict()
    labels = pq.read_table(f"{d}/labels.parquet").to_pydict()
    rows = {r.doc_id: r for r in quality.query(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()}
    for i, text in zip(docs["doc_id"], docs["text"]):
        want = _brute(text)
        assert tuple(rows[i][c] for c in quality.BASE) == want
        assert rows[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (rows[i].base_failed and rows[i].kept)
    _verdicts_follow_the_rules(spark, d, docs, rows)
    good = [rows[i] for i, q in zip(labels["doc_id"], labels["quality"]) if q and not rows[i].base_failed]
    bad = [rows[i] for i, q in zip(labels["doc_id"], labels["quality"]) if not q]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad)


def test_covering_finds_planted_conjunction():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 1000, (3000, 3))
    bad = (rows[:, 0] >= 700) & (rows[:, 2] <= 400)
    rules = quality.Covering(["a", "b", "c"], rows, bad).rules()
    assert rules
    fired = np.zeros(len(rows), bool)
    for rule in rules:
        fired |= np.logical_and.reduce([x.holds(rows[:, "abc".index(x.measure)]) for x in rule])
    assert (fired == bad).mean() > 0.97


def test_covering_without_signal_rejects_nothing():
    rng = np.random.default_rng(1)
    assert quality.Covering(["a"], rng.integers(0, 100, (500, 1)), rng.random(500) < 0.2).rules() == []
    assert quality.Covering(["a"], np.zeros((4, 1), int), np.zeros(4, bool)).rules() == []


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.query(odd_docs, labels).collect()
    assert len(rows) == 9
    for r in rows:
        assert r.kept is not None and r.base_failed is not None
    four = next(r for r in rows if r.doc_id == 4)
    assert (four.n_words, four.n_repeat_words, four.base_failed, four.kept) == (60_000, 60_000, True, False)
    out = quality.judge(odd_docs.withColumn("stats", F.lit(1)), [])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "stats", "base_failed", "kept"]
    assert quality.query(odd_docs.limit(0), labels).count() == 0
    assert quality.query(odd_docs, labels.limit(0)).count() == 9


def test_repeats_that_touch_and_overlap(spark):
    a = " ".join(f"w{i}" for i in range(8))
    texts = [f"{a} {a}", f"{a} x {a}", f"{a} y0 y1 {a} w0", "z " * 9, a, f"{a} {a} {a} q", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.s["n_repeat_words"] for r in df.select(quality.statistics(F.col("text")).alias("s")).collect()]
    assert got == [_brute(t)[4] for t in texts]


def test_plan_is_native(spark, odd_docs):
    rule = (quality.Literal("n_words", True, 5), quality.Literal("upper_per_1000_chars", False, 9))
    plan = quality.judge(spark.range(3).select(F.lit("a").alias("text")), [rule])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
