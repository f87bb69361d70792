"""Top k without scoring every match: postings in blocks with an upper bound of their scores.

Documents of about one length, dealt by a hash, form an area of about ``size`` documents. A
block holds a term's postings in one area that have about the same tf (a tier), with their
highest tf and shortest length. What those allow bounds the part of a score that any of
its postings gives; a term's highest part in an area, summed over the terms, bounds every
document of it.

A search reads the bounds alone. It scores the areas that promise most; then it reads only
blocks whose own part, with the highest parts of the other terms there, still reaches the
k-th best score. A document with a posting in another block cannot be among the best, so
that leaving such a posting out changes no result; of negated terms, all of an area is read.
The result is exactly that of scoring all matches. Frequent terms have many blocks and no
block is large, so no term is hot.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.index import Index
from quillspark.operators.ranking import Bm25, search, top
from quillspark.plans.boolean import Expr, Query

_PER_OCTAVE = 8  # classes of length between a length and its double: at most 8 * 63 of them
_LISTED = 2048  # blocks that the driver names one by one; more are joined
_FIRST = 8  # areas that are scored to find out what a result must reach
_TIE = 1e-8  # ranks round scores to nine digits


@dataclass
class BlockIndex:
    """``blocks``: term, area, tier, n, max_tf, min_dl and postings (doc_id, tf, dl), sorted by term, area and tier."""

    index: Index
    blocks: DataFrame

    def write(self, path: str) -> "BlockIndex":
        self.blocks.write.mode("overwrite").parquet(path)
        return replace(self, blocks=self.blocks.sparkSession.read.schema(self.blocks.schema).parquet(path))


def read_blocks(spark: SparkSession, path: str, index: Index) -> BlockIndex:
    return BlockIndex(index, spark.read.parquet(path))


def _class(dl: Column) -> Column:
    return F.floor(F.log2(F.greatest(dl, F.lit(1)).cast("double")) * _PER_OCTAVE).cast("int")


def _tier(tf: Column) -> Column:
    """1, 2 and 3 are tiers of their own, above them each half of a doubling."""
    return F.floor(F.log2(tf.cast("double")) * 2).cast("int")


def build_blocks(index: Index, size: int = 256) -> BlockIndex:
    """Blocks over the postings of ``index``, about ``size`` documents to an area."""
    # One row per class of length: a bounded number, whatever the corpus.
    classes = index.doc_stats.where((F.col("dl") > 0) & ~F.col("failed")).groupBy(_class(F.col("dl")).alias("c")).count().collect()
    parts = {r["c"]: max(1, math.ceil(r["count"] / size)) for r in classes}
    of = F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair]) if parts else F.create_map(F.lit(0), F.lit(1))
    c = _class(F.col("dl"))
    within = F.pmod(F.xxhash64("doc_id"), F.coalesce(F.try_element_at(of, c), F.lit(1)).cast("long"))
    rows = index.postings.withColumns({"area": F.shiftleft(c.cast("long"), 48).bitwiseOR(within), "tier": _tier(F.col("tf"))})
    ranged = rows.repartitionByRange("term", "area", "tier").groupBy("term", "area", "tier").agg(
        F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"),
        F.array_sort(F.collect_list(F.struct("doc_id", "tf", "dl"))).alias("postings"))
    return BlockIndex(index, ranged.sortWithinPartitions("term", "area", "tier"))


def _weights(index: Index, bag: Counter, method: str) -> dict[str, float]:
    """What a term's part of a score is multiplied with; 0 for unknown terms."""
    df, n = index.document_frequencies(list(bag)), index.n
    idf = {"tfidf": lambda d: math.log(n / d), "bm25": lambda d: math.log((n - d + 0.5) / (d + 0.5) + 1)}[method]
    return {t: bag[t] * idf(d) for t, d in df.items() if d}


def _bound(index: Index, method: str, bm25: Bm25) -> Column:
    """The greatest part of a score, before its weight, that a block's postings allow."""
    tf = F.col("max_tf").cast("double")
    if method == "tfidf":
        return tf
    avgdl = index.corpus["avgdl"] or 1.0
    return (bm25.k1 + 1) * tf / (bm25.k1 * ((1 - bm25.b) + bm25.b * F.col("min_dl") / avgdl) + tf)


def _may_match(e: Expr) -> Expr | None:
    """Which terms an area must have so that a document of it can match; None: any."""
    if e.op == "TERM":
        return e
    if e.op == "NOT":
        return None
    sides = [_may_match(a) for a in e.args]
    if e.op == "OR":
        return None if None in sides else Expr("OR", tuple(sides))
    known = [s for s in sides if s is not None]
    return Expr("AND", tuple(known)) if len(known) == 2 else known[0] if known else None


def _negated(e: Expr, inside: bool = False) -> set[str]:
    """Terms that stand under a NOT."""
    if e.op == "TERM":
        return {e.term} if inside else set()
    return set().union(*(_negated(a, inside or e.op == "NOT") for a in e.args))


def bounds(blocks: BlockIndex, query: Query, method: str, bm25: Bm25 = Bm25()) -> DataFrame:
    """(area, bound, blocks) of areas that can hold a match.

    ``bound`` is that of the scores of an area's documents, ``blocks`` has (term, tier, n,
    reach): the highest score of a document with a posting in the block. Only terms, areas and
    figures are read, not the postings.
    """
    weights = _weights(blocks.index, Counter(query.bag), method)
    needed = sorted(query.matches.terms() | set(query.bag))
    weight = F.lit(0.0)
    for t, w in weights.items():
        # A posting under a negative weight only lowers a score.
        weight = F.when(F.col("term") == t, F.lit(max(w, 0.0))).otherwise(weight)
    rows = blocks.blocks.where(F.col("term").isin(needed)).select("term", "area", "tier", "n", (weight * _bound(blocks.index, method, bm25)).alias("part"))
    parts = [F.max(F.when(F.col("term") == t, F.col("part"))) for t in needed]
    areas = rows.groupBy("area").agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)], F.collect_list(F.struct("term", "tier", "n", "part")).alias("blocks"))
    of = {t: F.col(f"_{i}") for i, t in enumerate(needed)}
    need = _may_match(query.matches)
    if need is not None:
        areas = areas.where(need.condition(lambda t: of[t].isNotNull()))
    bound = sum((F.coalesce(c, F.lit(0.0)) for c in of.values()), F.lit(0.0))
    highest = F.create_map(*[x for t, c in of.items() for x in (F.lit(t), c)])
    whole = F.array(*[F.lit(t) for t in sorted(_negated(query.matches))]).cast("array<string>")

    def reach(b: Column) -> Column:
        return F.when(F.array_contains(whole, b["term"]), F.col("bound")).otherwise(F.col("bound") - F.try_element_at(highest, b["term"]) + b["part"])

    areas = areas.withColumns({"bound": bound, "highest": highest})
    return areas.select("area", "bound", F.transform("blocks", lambda b: F.struct(b["term"].alias("term"), b["tier"].alias("tier"), b["n"].alias("n"), reach(b).alias("reach"))).alias("blocks"))


@dataclass
class PrunedTop:
    """The result, and how many postings of how many were read for it."""

    rows: DataFrame
    read: int
    of: int


def pruned_top(blocks: BlockIndex, query: Query, k: int = 10, method: str = "bm25", bm25: Bm25 = Bm25()) -> PrunedTop:
    """(rank, doc_id, score) of the best ``k``, as ``ranking.top`` of ``ranking.search`` has them.

    Scores without a bound (vector, none), and queries that documents without any of the
    terms match, score all matches.
    """
    index = blocks.index
    terms = sorted(query.matches.terms() | set(query.bag)) if query.matches else []
    of = sum(index.document_frequencies(terms).values())
    if query.matches is None or query.needs_universe or method not in ("tfidf", "bm25"):
        return PrunedTop(top(search(index, query, method, bm25), k), of, of)
    areas = bounds(blocks, query, method, bm25)
    keys = ["term", "area", "tier"]

    def best(chosen: DataFrame) -> DataFrame:
        rows = chosen.select("term", F.explode("postings").alias("p")).select("term", "p.*")
        return top(search(replace(index, postings=rows), query, method, bm25), k)

    first = [r["area"] for r in areas.orderBy(F.desc("bound"), "area").limit(_FIRST).select("area").collect()]
    tried = blocks.blocks.where(F.col("area").isin(first) & F.col("term").isin(terms))
    scores = [r["score"] for r in best(tried).collect()]
    # What the k-th best of a part of the documents has, the k-th best of all has at least.
    least = min(scores) - _TIE if len(scores) == k else -math.inf
    left = areas.where(F.col("bound") >= least).select("area", F.inline("blocks")).where(F.col("reach") >= least)
    again = tried.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    named = left.select(*keys, "n").limit(_LISTED + 1).collect()
    if len(named) <= _LISTED:
        # Areas and terms are told to the scan, tiers to a join with no more rows than that.
        wanted = blocks.blocks.sparkSession.createDataFrame([tuple(r)[:3] for r in named], "term string, area long, tier int")
        near = blocks.blocks.where(F.col("term").isin(terms) & F.col("area").isin(sorted({r["area"] for r in named})))
        return PrunedTop(best(near.join(F.broadcast(wanted), keys, "left_semi")), again + sum(r["n"] for r in named), of)
    n = left.agg(F.sum("n").alias("n")).first()["n"]
    return PrunedTop(best(blocks.blocks.where(F.col("term").isin(terms)).join(left.select(*keys), keys, "left_semi")), again + n, of)
