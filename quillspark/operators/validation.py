"""Evaluation of rankings: features, principles, score statistics, stability, latency."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.analysis import WHITE, base_name
from quillspark.operators import ranking
from quillspark.plans.engine import SearchEngine

SCORED = ("tfidf", "bm25", "vector")


def doc_features(docs: DataFrame, words: dict[str, str], flag: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the given words, total and distinct terms, and whether the word of ``flag`` occurs."""
    w = F.filter(F.split(F.lower(text), f"[{WHITE}]+"), lambda x: x != "")
    d = docs.select(F.col(doc_id).alias("doc_id"), w.alias("w"))
    count = lambda x: F.size(F.filter("w", lambda y: y == x)).cast("long")
    return d.select(
        "doc_id", *[count(x).alias(f"{name}_count") for name, x in words.items()], F.size("w").cast("long").alias("total_terms"),
        F.size(F.array_distinct("w")).cast("long").alias("unique_terms"), F.array_contains("w", words[flag]).alias(f"has_{flag}"))


def score_stats(scores: DataFrame, by: Iterable[str] = ("method", "query"), least_range: float = 0.01) -> DataFrame:
    """Highest, lowest, range, whether it tells documents apart, and whether all lie in [0, 1]."""
    s = F.col("score")
    out = scores.groupBy(*by).agg(F.count("*").alias("n"), F.max(s).alias("highest"), F.min(s).alias("lowest"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.bool_and((s >= 0) & (s <= 1.001)).alias("in_unit_range"))
    return out.withColumn("range", F.col("highest") - F.col("lowest")).withColumn("distinct_scores", F.col("range") > least_range)


def all_scores(engine: SearchEngine, queries: Iterable[str], methods: Iterable[str] = SCORED) -> DataFrame:
    """(method, query, doc_id, score) of disjunctive searches."""
    out = None
    for m in methods:
        for q in queries:
            one = engine.with_ranking(m).search_any(q).select(F.lit(m).alias("method"), F.lit(q).alias("query"), "doc_id", "score")
            out = one if out is None else out.unionByName(one)
    return out


# Documents of the ranking fixture that the principles name.
FREQUENT, RARE, BOTH, DIVERSE = ("doc1.txt", "doc9.txt"), {"doc5.txt", "doc8.txt"}, ("doc1.txt", "doc2.txt", "doc3.txt", "doc5.txt", "doc10.txt"), {"doc3.txt", "doc4.txt", "doc10.txt"}


def principles(ranked: DataFrame) -> DataFrame:
    """(method, query, check, pass) of ranked fixture documents (method, query, rank, name): frequent words, rare words, both words, diversity.

    A check has a row where its words are asked for and its method is meant; the five best
    documents of each ranking count.
    """
    best = ranked.where(F.col("rank") <= 5)
    rank_of = lambda names: F.min(F.when(F.col("name").isin(sorted(names)), F.col("rank")))
    found = best.groupBy("method", "query").agg(
        rank_of(FREQUENT).alias("frequent"), rank_of(BOTH).alias("both"), rank_of(DIVERSE).alias("diverse"),
        F.count_distinct(F.when(F.col("name").isin(sorted(RARE)), F.col("name"))).alias("rare"),
        rank_of(["doc1.txt"]).alias("higher"), rank_of(["doc3.txt"]).alias("lower"))
    asks = lambda word: F.contains(F.lower("query"), F.lit(word))
    apple, both = asks("apple") & ~asks("rare"), asks("apple") & asks("banana")
    high = lambda c: F.coalesce(F.col(c) <= 3, F.lit(False))
    rules = [
        ("frequent word ranks high", apple & (F.col("method") != "vector"), high("frequent")),
        ("all documents with the rare word", asks("rare_term"), F.col("rare") == len(RARE)),
        ("both words rank high", both, high("both")),
        ("higher frequency first", apple & (F.col("method") == "tfidf") & F.col("higher").isNotNull() & F.col("lower").isNotNull(), F.col("higher") < F.col("lower")),
        ("diverse documents near the top", both & (F.col("method") == "vector"), high("diverse")),
    ]
    rows = F.array(*[F.struct(F.lit(check).alias("check"), applies.alias("applies"), holds.alias("pass")) for check, applies, holds in rules])
    return found.select("method", "query", F.inline(rows)).where("applies").drop("applies")


def validate_principles(engine: SearchEngine, query: str) -> DataFrame:
    """(check, pass) of one query in the engine's method."""
    ranked = ranking.top(engine.search_any(query), 5).select(F.lit(engine.method).alias("method"), F.lit(query).alias("query"), "rank", base_name(F.col("doc_id")).alias("name"))
    return principles(ranked).select("check", "pass")


def stability(runs: list[DataFrame], k: int = 5) -> DataFrame:
    """Over several rankings (rank, doc_id): per rank the documents seen, and whether always one."""
    union = None
    for i, r in enumerate(runs):
        one = r.where(F.col("rank") <= k).select(F.lit(i).alias("run"), "rank", F.col("doc_id").cast("string").alias("doc_id"))
        union = one if union is None else union.unionByName(one)
    seen = union.groupBy("rank").agg(F.array_sort(F.collect_set("doc_id")).alias("variations"), F.count_distinct("run").alias("n"))
    return seen.select("rank", "variations", ((F.size("variations") == 1) & (F.col("n") == len(runs))).alias("stable"))


def stability_score(runs: list[DataFrame], k: int = 5) -> float:
    return stability(runs, k).where("stable").count() / k


def timed(f: Callable[[], object]) -> float:
    begin = time.perf_counter()
    f()
    return time.perf_counter() - begin


def method_latency(engine: SearchEngine, queries: Iterable[str], methods: Iterable[str] = ranking.METHODS, k: int = 10) -> DataFrame:
    """Mean seconds per ranking method, fastest first."""
    spark = engine.index.postings.sparkSession
    rows = [(m, timed(engine.with_ranking(m).top(q, k).collect)) for m in methods for q in queries]
    return spark.createDataFrame(rows, "method string, seconds double").groupBy("method").agg(F.avg("seconds").alias("mean_seconds")).orderBy("mean_seconds")


def compare_layouts(layouts: dict[str, Callable[[str], DataFrame]], queries: Iterable[str], spark: SparkSession) -> DataFrame:
    """Seconds of each query on each physical layout, and how many times the first layout's it takes.

    Executors read all rows of a result; none comes to the driver.
    """
    rows = [(name, q, timed(f(q).write.format("noop").mode("overwrite").save)) for name, f in layouts.items() for q in queries]
    first = {q: s for name, q, s in rows if name == next(iter(layouts))}
    return spark.createDataFrame([(n, q, s, s / first[q] if first[q] else float("inf")) for n, q, s in rows], "layout string, query string, seconds double, times double")


def peak_memory_mb() -> float:
    """Peak resident memory of the driver's Python process."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def executor_memory(spark: SparkSession) -> DataFrame:
    """(executor, heap_mb, off_heap_mb, execution_mb): peaks that Spark has seen so far, the driver's own included.

    A peak is known once an executor has sent a heartbeat or ended a stage; before, it is 0.
    """
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    rows = []
    for i in range(found.size()):
        e, peaks = found.apply(i), found.apply(i).peakMemoryMetrics()
        mb = lambda name: peaks.get().getMetricValue(name) / 2**20 if peaks.isDefined() else 0.0
        rows.append((e.id(), mb("JVMHeapMemory"), mb("JVMOffHeapMemory"), mb("OnHeapExecutionMemory")))
    return spark.createDataFrame(rows, "executor string, heap_mb double, off_heap_mb double, execution_mb double")
