r"""Quality rules: learned decision lists over statistics of whole texts.

Statistics are Spark expressions over the words ``[^\x20\x09-\x0D]+`` and the lines of a
text. From labelled statistics, sequential covering learns rules that reject: each rule is
grown literal by literal (threshold conditions, best information gain) on one part of the
labelled rows, pruned on the other, kept if precise enough there, and the rows it covers
are set aside before the next. The rules are emitted as one ordered ``CASE`` expression.

Defined results: a null text has no words and fails the base rule (fewer than 20 words, or
more than 30 % of the words in repeated 8-word windows); without labels, or without rejected
ones among them, the list is empty and only the base rule rejects; keys with
conflicting labels teach nothing; repeated rows give repeated results; very long texts are
measured whole; an empty table gives no rows; other columns pass through, clashing ones are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matching(text: Column, others: str) -> Column:
    """How many characters are left when runs of ``others`` are deleted."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more, every word once."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        marked = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["i"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def words(p: Column) -> Column:
        new = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    return let(ordered, lambda s: let(repeated(s), words)).cast("long")


def _repeat_words(words: Column) -> Column:
    def of_hashes(h: Column) -> Column:
        # 64-bit hashes of the eight words stand for a window.
        window = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(window, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def statistics(text: Column) -> Column:
    """A struct of the five base numbers and of what the learned rules read besides."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    stats = F.struct(
        let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
        _matching(t, r"[^#*$%&|<>]+").alias("n_symbols"), _matching(t, r"[^\p{Lu}]+").alias("n_upper"),
        _matching(t, r"[^!?]+").alias("n_shouts"), _matching(t, r"[^0-9]+").alias("n_digits"))
    return let(stats, lambda s: F.struct(
        *[s["w"][c].alias(c) for c in ("n_words", "word_chars", "n_distinct", "n_repeat_words")],
        *[s["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")],
        *[s[c].alias(c) for c in ("n_symbols", "n_upper", "n_shouts", "n_digits")]))


def measures(stats: Column) -> dict[str, Column]:
    """What conditions are about: per mille shares, as integers, and mean lengths."""
    share = lambda a, b: F.floor(1000 * stats[a] / F.greatest(stats[b], F.lit(1))).cast("long")
    return {
        "n_words": stats["n_words"],
        "symbols_per_1000_chars": share("n_symbols", "word_chars"),
        "upper_per_1000_chars": share("n_upper", "word_chars"),
        "shouts_per_1000_words": share("n_shouts", "n_words"),
        "digits_per_1000_chars": share("n_digits", "word_chars"),
        "dup_per_1000_lines": share("n_dup_lines", "n_lines"),
        "repeated_per_1000_words": share("n_repeat_words", "n_words"),
        "distinct_per_1000_words": share("n_distinct", "n_words"),
        "chars_per_1000_words": share("word_chars", "n_words"),
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


@dataclass(frozen=True)
class Literal:
    measure: str
    above: bool
    threshold: int

    def of(self, column: Column) -> Column:
        return column >= self.threshold if self.above else column <= self.threshold

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.threshold if self.above else values <= self.threshold


Rule = tuple[Literal, ...]


class Covering:
    """Sequential covering of the rejected rows among labelled measures."""

    def __init__(self, names: list[str], rows: np.ndarray, bad: np.ndarray, thresholds: int = 40, precision: float = 0.9, least: int = 5, longest: int = 4, most_rules: int = 12):
        self.names, self.precision, self.least, self.longest, self.most_rules = names, precision, least, longest, most_rules
        self.rows, self.bad = rows, bad
        # Each third row, in the drawn order, prunes; the others grow.
        self.prune = np.arange(len(rows)) % 3 == 2
        steps = np.linspace(0, 1, thresholds)
        self.literals = []
        for j, name in enumerate(names):
            of_all, of_bad = rows[:, j], rows[bad, j]
            cuts = np.unique(np.r_[np.quantile(of_all, steps, method="nearest"), np.quantile(of_bad, steps, method="nearest")]) if bad.any() else []
            self.literals += [(j, Literal(name, up, int(c))) for c in cuts for up in (True, False)]
        self.masks = np.stack([x.holds(rows[:, j]) for j, x in self.literals]) if self.literals else np.zeros((0, len(rows)), bool)

    def _grow(self, open_: np.ndarray) -> list[int]:
        inside = open_ & ~self.prune
        rule: list[int] = []
        while len(rule) < self.longest:
            p0, n0 = (inside & self.bad).sum(), (inside & ~self.bad).sum()
            if not p0 or not n0:
                break
            p = (self.masks & (inside & self.bad)).sum(1)
            n = (self.masks & (inside & ~self.bad)).sum(1)
            gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0)))
            gain[p < self.least] = 0
            best = int(gain.argmax())
            if gain[best] <= 1e-9:
                break
            rule.append(best)
            inside &= self.masks[best]
        return rule

    def _inside(self, rule: list[int], rows: np.ndarray) -> np.ndarray:
        return rows & np.logical_and.reduce([self.masks[k] for k in rule]) if rule else rows

    def _pruned(self, rule: list[int], open_: np.ndarray) -> list[int]:
        def worth(part: list[int]) -> float:
            inside = self._inside(part, open_ & self.prune)
            p, n = (inside & self.bad).sum(), (inside & ~self.bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        # Shorter rules win ties.
        return max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)), default=[])

    def rules(self) -> list[Rule]:
        found: list[Rule] = []
        open_ = np.ones(len(self.rows), bool)
        while len(found) < self.most_rules and (open_ & self.bad & ~self.prune).sum() >= self.least:
            rule = self._pruned(self._grow(open_), open_)
            if not rule:
                break
            on_prune, everywhere = self._inside(rule, open_ & self.prune), self._inside(rule, open_)
            if everywhere.sum() < self.least or self.bad[everywhere].mean() < self.precision or (on_prune.any() and self.bad[on_prune].mean() < self.precision):
                break
            found.append(tuple(self.literals[k][1] for k in rule))
            open_ &= ~everywhere
        return found


def learn(docs: DataFrame, labels: DataFrame, row_key: str = "doc_id", label: str = "quality", text: str = "text", rows: int = 8000) -> list[Rule]:
    """Rules from at most ``rows`` labelled keys (label 0: reject), the first in the order of a hash of theirs.

    A key with conflicting labels has none. A key of several documents labels all of them, of
    which at most 2 * ``rows`` are looked at.
    """
    given = labels.where(F.col(row_key).isNotNull() & F.col(label).isNotNull()).groupBy(row_key).agg(F.min(F.col(label) == 0).alias("_bad"), F.max(F.col(label) == 0).alias("_most"))
    known = given.where(F.col("_bad") == F.col("_most")).drop("_most")
    n = known.count()
    if not n:
        return []
    known = known.withColumn("_hash", F.xxhash64(row_key))
    drawn = F.pmod("_hash", F.lit(1 << 20)) < int(min(1.0, 0.9 * rows / n) * (1 << 20))
    # The limit proves the size of what is broadcast; the texts need not move.
    sample = docs.select(row_key, text).join(F.broadcast(known.where(drawn).orderBy("_hash", row_key).limit(rows)), row_key)
    # One expression holds all measures, so that no pushed filter computes the statistics again.
    one = let(statistics(F.col(text)), lambda s: F.struct(base_failed(s).alias("base"), F.array(*measures(s).values()).alias("values")))
    got = sample.select("_hash", row_key, "_bad", one.alias("m")).orderBy("_hash", row_key, F.to_json("m")).limit(2 * rows).collect()
    got = [r for r in got if not r["m"]["base"]]
    if not got:
        return []
    names = list(measures(F.col("stats")))
    return Covering(names, np.asarray([r["m"]["values"] for r in got], np.int64), np.asarray([r["_bad"] for r in got], bool)).rules()


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """True where no rule of the ordered list rejects."""
    m = measures(stats)
    out = None
    for rule in rules:
        condition = None
        for x in rule:
            condition = x.of(m[x.measure]) if condition is None else condition & x.of(m[x.measure])
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Add ``stats``, ``base_failed`` and ``kept`` to each document."""
    others = [c for c in docs.columns if c not in ("stats", "base_failed", "kept", "_judged")]

    def of_stats(s: Column) -> Column:
        failed = base_failed(s)
        return F.struct(s.alias("stats"), failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict(s, rules)).alias("kept"))

    judged = docs.select(*others, let(statistics(F.col(text)), of_stats).alias("_judged"))
    return judged.select(*others, *[F.col("_judged")[c].alias(c) for c in ("stats", "base_failed", "kept")])


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn(docs, labels)
    out = judge(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", *[F.col("stats")[c].alias(c) for c in BASE], "base_failed", "kept")
