"""Periodic runs of words: where a text repeats itself in place, and the text without the repeats.

A run is a stretch of consecutive words with smallest period q and a length of at least
``least`` words and ``exponent`` periods, which no neighbouring word extends. All runs of a
text come from its longest Lyndon words: a stack is scanned from right to left under an
order of the words and under its reverse, and each word's longest Lyndon word is the root
of the only run that it can be a root of. Suffixes are compared, and roots extended, by
binary search over prefix hashes; what two hashes call equal is compared word by word
before it is believed, each stretch of a distance once.

Before the scan a text is cut: a window of three words in a run comes at least
``exponent`` - 1 times within it, so windows that are rarer in their stretch lie in no run.
Ordinary prose is gone after that.

Defined results: words are what ASCII white space separates; a null, empty or blank text
has no words, no runs and an empty collapsed text; very long texts are scanned whole, in
memory of the order of the text; repeated rows and ids are rows of their own; an empty
table gives no rows; further columns are carried through unless they clash with n_words,
runs or collapsed, which then win. Rows never meet, so no group of them can be hot.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import WORD_SPACE, mapped

_PRIME = (1 << 61) - 1
_BASE = 0x1B873593C2B2AE35 % _PRIME
_ROUNDS = 8  # of cutting; what is left over is scanned, however much it is


class _Stretch:
    """One stretch of word numbers with its prefix hashes and what is known of its distances."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.raw = array("i", words).tobytes()
        self.hashes, self.powers = [0], [1]
        h, p = 0, 1
        for w in words:
            h = (h * _BASE + w + 1) % _PRIME
            p = p * _BASE % _PRIME
            self.hashes.append(h)
            self.powers.append(p)
        # distance -> (lo, hi): words lo to hi equal those so far on, verified; word hi does not.
        self.equal: dict[int, tuple[int, int]] = {}

    def _same(self, i: int, j: int, length: int) -> bool:
        h = self.hashes
        return (h[i + length] - h[j + length] + (h[j] - h[i]) * self.powers[length]) % _PRIME == 0

    def _verified(self, i: int, j: int, length: int) -> int:
        """How many of ``length`` words are equal from ``i`` and from ``j`` on, word by word."""
        raw = self.raw
        if raw[4 * i : 4 * (i + length)] == raw[4 * j : 4 * (j + length)]:
            return length
        return next(k for k in range(length) if self.words[i + k] != self.words[j + k])

    def ahead(self, i: int, j: int) -> int:
        """Words that agree from ``i`` and ``j`` > i on."""
        words = self.words
        if words[i] != words[j]:
            return 0
        known = self.equal.get(j - i)
        if known and known[0] <= i < known[1]:
            return known[1] - i
        most, good, step = self.n - j, 1, 2
        while good < most:
            reach = min(step, most)
            if not self._same(i, j, reach):
                break
            good, step = reach, 2 * step
        else:
            reach = most + 1
        bad = reach
        while bad - good > 1:
            middle = (good + bad) // 2
            if self._same(i, j, middle):
                good = middle
            else:
                bad = middle
        if known and i < known[0] <= i + good:
            # Up to what is verified already.
            new = known[0] - i
            length = self._verified(i, j, new)
            length = known[1] - i if length == new else length
        else:
            length = self._verified(i, j, good)
        self.equal[j - i] = (i, i + length)
        return length

    def behind(self, i: int, j: int) -> int:
        """Words that agree before ``i`` and ``j`` > i, going left."""
        words = self.words
        if i == 0 or words[i - 1] != words[j - 1]:
            return 0
        good, step = 1, 2
        while good < i:
            reach = min(step, i)
            if not self._same(i - reach, j - reach, reach):
                break
            good, step = reach, 2 * step
        else:
            reach = i + 1
        bad = reach
        while bad - good > 1:
            middle = (good + bad) // 2
            if self._same(i - middle, j - middle, middle):
                good = middle
            else:
                bad = middle
        if self._verified(i - good, j - good, good) < good:
            good = next(k for k in range(good) if words[i - 1 - k] != words[j - 1 - k])
        return good

    def runs(self, least: int, exponent: int) -> set[tuple[int, int, int]]:
        """(start, length, period) of all runs."""
        found: set[tuple[int, int, int]] = set()
        words, n, ahead = self.words, self.n, self.ahead
        for upward in (True, False):
            after = [0] * n  # where the longest Lyndon word from here ends
            seen: dict[int, tuple[int, int]] = {}  # period -> the run of it found last
            for i in range(n - 1, -1, -1):
                j, right, w = i + 1, 0, words[i]
                while j < n:
                    v = words[j]
                    if w != v:
                        right = 0
                        if (w < v) != upward:
                            break
                    else:
                        right = ahead(i, j)
                        # A suffix that ends is the smaller one, under both orders.
                        if j + right == n or (words[i + right] < words[j + right]) != upward:
                            break
                    j = after[j]
                else:
                    right = 0
                after[i] = j
                p = j - i
                last = seen.get(p)
                if last and last[0] <= i and j <= last[1]:
                    continue
                left = self.behind(i, j)
                length = left + p + right
                if length >= 2 * p:
                    seen[p] = (i - left, j + right)
                    if length >= least and length >= exponent * p:
                        found.add((i - left, length, p))
        return found


def _codes(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _stretches(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """The stretches (from, to) outside of which no run can lie."""
    n, times = len(ids), exponent - 1
    if n < least:
        return []
    if times < 2:
        return [(0, n)]
    many = int(ids.max()) + 1
    pairs = ids[:-2] * many + ids[1:-1]
    keys = (_codes(pairs) if many > 1_000_000 else pairs) * many + ids[2:]
    ordered = np.sort(keys)
    if len(keys) < times or not (ordered[times - 1 :] == ordered[: len(ordered) - times + 1]).any():
        return []
    at, keys = np.arange(len(keys)), _codes(keys)
    segment = np.zeros(len(keys), np.int64)
    for _ in range(_ROUNDS):
        code = _codes(segment * len(ids) + keys)
        good = np.bincount(code)[code] >= times
        at, keys = at[good], keys[good]
        if not len(at):
            return []
        # Consecutive windows form a stretch, which is long enough for a run or goes.
        segment = np.cumsum(np.r_[0, np.diff(at) != 1])
        long = np.bincount(segment)[segment] >= least - 2
        at, keys, segment = at[long], keys[long], segment[long]
        if good.all() and long.all():
            break
    if not len(at):
        return []
    edges = np.flatnonzero(np.diff(segment)) + 1
    return [(int(at[lo]), int(at[hi - 1]) + 3) for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(at)])]


def runs_of(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a list of words, by start and period."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found: list[tuple[int, int, int]] = []
    for lo, hi in _stretches(ids, least, exponent):
        found += [(lo + s, length, p) for s, length, p in _Stretch(ids[lo:hi].tolist()).runs(least, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stand in no run after its first period, joined by one space."""
    if runs:
        gone = bytearray(len(words))
        for start, length, period in runs:
            gone[start + period : start + length] = b"\1" * (length - period)
        words = [w for w, g in zip(words, gone) if not g]
    return b" ".join(words)


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def periodic_runs(df: DataFrame, text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """Add n_words, runs (by start, then period) and collapsed, the text without what its runs repeat."""
    if not 2 <= exponent < least:
        raise ValueError("exponent must be at least 2, and least above it")
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    kept = [f for f in df.schema.fields if f.name not in {c.name for c in new}]
    names = [f.name for f in kept]
    one = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, starts, flat, short = [], [0], [], []
            for t in batch.column(text).cast(pa.binary()):
                words = (t.as_py() or b"").split()
                found = runs_of(words, least, exponent)
                counts.append(len(words))
                flat += found
                starts.append(len(flat))
                short.append(collapsed(words, found))
            columns = list(zip(*flat)) if flat else [(), (), ()]
            structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(one))
            runs = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), structs)
            values = {n: batch.column(n) for n in names} | {"n_words": pa.array(counts, pa.int64()), "runs": runs, "collapsed": pa.array(short, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict(values)

    columns = names if text in names else [*names, text]
    return mapped(df.select(*columns), run, T.StructType(kept + new))


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null without runs."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    better = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast(kind), better)


def _planted(doc_id: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids one whose words repeat with a period from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, WORD_SPACE), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    """Runs of every whole text and the collapsed text, as figures and digests; rows without an id keep their text."""
    found = periodic_runs(docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("best", best_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
