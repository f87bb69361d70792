"""Scores of matching documents, as one aggregate over the postings of the query's terms."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.index import Index
from quillspark.plans.boolean import Query

METHODS = ("none", "tfidf", "bm25", "vector")


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


def _sum_by_term(value: Column, weights: dict[str, float]) -> Column:
    """Sum of ``value`` times the weight of the row's term."""
    per_row = F.lit(0.0)
    for term, weight in weights.items():
        per_row = F.when(F.col("term") == term, value * F.lit(weight)).otherwise(per_row)
    return F.sum(per_row)


def _safe(score: Column, known: Column) -> Column:
    return F.when(known, score).otherwise(F.lit(0.0))


def search(index: Index, query: Query, method: str = "bm25", bm25: Bm25 = Bm25()) -> DataFrame:
    """(doc_id, score) of all matching documents.

    One scan of the query terms' postings gives match flags and score parts. Only a query
    that also matches documents without any of its terms reads the universe. ``none``, and
    a query without operands, scores 0; another unknown method 1.
    """
    if query.matches is None:
        return index.doc_stats.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    bag = Counter(query.bag)
    df = index.document_frequencies(list(bag))
    known = {t: n for t, n in df.items() if n}
    of = {t: f"_{i}" for i, t in enumerate(sorted(query.matches.terms()))}
    rows = index.postings.where(F.col("term").isin(sorted(set(bag) | set(of))))
    flags = [F.max(F.col("term") == t).alias(c) for t, c in of.items()]
    tf, n = F.col("tf").cast("double"), index.n
    parts: list[Column] = []
    if method == "tfidf":
        parts = [_sum_by_term(tf, {t: math.log(n / d) * bag[t] for t, d in known.items()}).alias("score")]
    elif method == "vector":
        idf = {t: math.log(n / d) for t, d in known.items()}
        parts = [
            _sum_by_term(tf, {t: w * w * bag[t] for t, w in idf.items()}).alias("dot"),
            _sum_by_term(tf * tf, {t: w * w for t, w in idf.items()}).alias("norm2"),
        ]
    elif method == "bm25":
        avgdl = index.corpus["avgdl"] or 1.0
        saturated = (bm25.k1 + 1) * tf / (bm25.k1 * ((1 - bm25.b) + bm25.b * F.col("dl") / avgdl) + tf)
        parts = [_sum_by_term(saturated, {t: math.log((n - d + 0.5) / (d + 0.5) + 1) * bag[t] for t, d in known.items()}).alias("score")]
    found = rows.groupBy("doc_id").agg(*flags, *parts)
    if query.needs_universe:
        found = index.universe().join(found, "doc_id", "left")
    hit = query.matches.condition(lambda t: F.coalesce(F.col(of[t]), F.lit(False)))
    found = found.where(hit)
    if method == "vector":
        q2 = sum((bag[t] * math.log(n / d)) ** 2 for t, d in known.items())
        norms = F.sqrt("norm2") * F.lit(math.sqrt(q2))
        score = _safe(F.col("dot") / F.when(norms > 0, norms), norms > 0)
    elif method in ("tfidf", "bm25"):
        score = F.coalesce("score", F.lit(0.0))
    else:
        score = F.lit(0.0 if method == "none" else 1.0)
    return found.select("doc_id", score.alias("score"))


def order_of(score: Column | None = None) -> list[Column]:
    """Best first; sums differ in their last bits between partitionings, so ties are ties to 9 digits."""
    s = F.col("score") if score is None else score
    return [F.desc(F.round(s, 9)), F.asc("doc_id")]


def top(scored: DataFrame, k: int) -> DataFrame:
    """(rank, doc_id, score) of the best ``k``; only they are sorted and numbered."""
    best = scored.orderBy(*order_of()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order_of())).cast("long")).select("rank", "doc_id", "score")


def top_per_group(scored: DataFrame, group: str, k: int) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order_of())).cast("long"))
    return ranked.where(F.col("rank") <= k)
