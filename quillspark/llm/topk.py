"""Exact top-k search by term-at-a-time accumulation over blocks of postings.

The dimensions of the vectors are the terms. A block of candidates is held as one postings
list per term (places and weights of its non-zero components); a block of query rows walks
its terms in turn and scatters query weight times posting weight into a dense array of
scores. The best k of a block are taken by partition selection, and the blocks' lists are
merged by one window. Query blocks go to every candidate block by an equal-key join.

Defined results: components are floor(scale * x), exactly; vectors that are null, of another
length than the query, or hold a null or non-finite component take no part, nor do rows
without an id; a query's own id is no candidate; ties go to the smaller id; repeated rows of
an id are candidates each. Query rows of one id with different vectors are queries of their
own, each with ranks from 1; wholly repeated ones are answered once. Scores are exact
integers at every size of the components; a score beyond 64 bits is shown as the nearest
64-bit integer, but ranked by its exact value. No rows, or no query among them, give an empty
result; an empty vector has score 0 with other empty ones. Other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RESULT = "query_id long, query_key long, vec_id long, score long, beyond int, digits binary"
_LONG = 2**63 - 1


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Ids and components, as doubles, of the vectors that take part."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(v.isNotNull() & F.col(vec_id).isNotNull() & ~odd).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))


def _matrix(vectors: list[np.ndarray], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense rows of quantised components of the widest length, and the length of each.

    64-bit integers if no component is beyond 2**52, else Python's unbounded ones.
    """
    sizes = np.asarray([len(v) for v in vectors], np.int64)
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out[rows, :n] = np.stack([vectors[i] for i in rows]) if n else 0
    if not out.size or np.abs(out).max() * scale <= 2.0**52:
        return np.floor(out * scale).astype(np.int64), sizes
    exact = np.empty(out.shape, object)
    for at, x in np.ndenumerate(out):
        # A double of this size or more is an integer itself.
        exact[at] = int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale))
    return exact, sizes


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every partial sum of inner products of the rows stays within 64 bits."""
    if not a.size or not b.size:
        return True
    return int(np.abs(a).max()) * int(np.abs(b).max()) * min(a.shape[1], b.shape[1]) <= _LONG


def _shown(score: int) -> tuple[int, int, bytes]:
    """The score within 64 bits, and what orders those that are not: (beyond, digits) ascend with them."""
    score = int(score)
    if -_LONG - 1 <= score <= _LONG:
        return score, 0, b""
    bits = abs(score).bit_length()
    digits = abs(score).to_bytes(-(-bits // 8), "big")
    return (_LONG, bits, digits) if score > 0 else (-_LONG - 1, -bits, bytes(255 - d for d in digits))


class Postings:
    """A block of candidates, sorted by id, as one postings list per term."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], scale: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.scale = ids[order], scale
        self.dense, self.sizes = _matrix([vectors[i] for i in order], scale)
        self.terms = [np.flatnonzero(self.dense[:, t]) for t in range(self.dense.shape[1])]

    def _scores(self, q: np.ndarray) -> np.ndarray:
        kind = np.int64 if q.dtype == self.dense.dtype == np.int64 and _fits(q, self.dense) else object
        q, weights = q.astype(kind), self.dense.astype(kind, copy=False)
        scores = np.zeros((len(q), len(self.ids)), kind)
        for t, at in enumerate(self.terms[: q.shape[1]]):
            everywhere = len(at) == len(self.ids)
            column = weights[:, t] if everywhere else weights[at, t]
            for row in np.flatnonzero(q[:, t]):
                if everywhere:
                    scores[row] += q[row, t] * column
                else:
                    scores[row, at] += q[row, t] * column
        return scores

    def best(self, queries: pd.DataFrame, k: int, step: int = 64) -> pd.DataFrame:
        out = []
        for lo in range(0, len(queries), step):
            some = queries.iloc[lo : lo + step]
            q, sizes = _matrix(list(some["v"]), self.scale)
            scores = self._scores(q)
            for row, (own, key) in enumerate(zip(some["vec_id"], some["query_key"])):
                able = np.flatnonzero((self.ids != own) & (self.sizes == sizes[row]))
                s = scores[row, able]
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    above = np.flatnonzero(s > least)
                    # Ids ascend, so the first ties are those of the smaller ids.
                    pick = np.r_[above, np.flatnonzero(s == least)[: k - len(above)]]
                else:
                    pick = np.arange(len(s))
                shown = [_shown(x) for x in s[pick]]
                out += [(own, key, i, *x) for i, x in zip(self.ids[able[pick]].tolist(), shown)]
        return pd.DataFrame(out, columns=["query_id", "query_key", "vec_id", "score", "beyond", "digits"])


def _search(k: int, scale: int):
    def run(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame(columns=["query_id", "query_key", "vec_id", "score", "beyond", "digits"])
        return Postings(block["vec_id"].to_numpy(), list(block["v"]), scale).best(queries, k)

    return run


def top_k(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, candidate_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """The ``k`` best candidates of each query row of ``df``: query_id, rank, vec_id, score.

    Blocks have about ``candidate_rows`` and ``query_rows`` rows, dealt by a hash of id and
    content; a pair of blocks is one group. Rows of ``df`` are queries where ``is_query``
    holds, a condition on ``vec_id``.
    """
    rows = usable(df, vec_id, vector)
    n, n_queries = rows.select(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, parts = max(1, -(-n // candidate_rows)), max(1, -(-n_queries // query_rows))
    deal = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(count)).cast("int")
    queries = rows.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("query_key", F.xxhash64("v")).withColumn("q", deal(parts, 1)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    candidates = rows.withColumn("c", deal(blocks, 2)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q")).applyInPandas(_search(k, scale), _RESULT)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("beyond"), F.desc("score"), F.desc("digits"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 50 == 0, 5)
