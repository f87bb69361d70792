"""Language identification by prediction by partial matching over bytes.

For each language a context tree over all 256 byte values is learned from labelled texts. Its
order varies: a context of up to ``order`` bytes is a node if it was seen often enough, so
frequent contexts are long and rare ones short. A byte costs -log2(c / (n + d)) where its
longest context was seen n times with d different successors, c times this one; an unseen
successor costs an escape, -log2(d / (n + d)), and is coded in the next shorter context, down
to the uniform distribution over bytes. (Bytes already ruled out by an escape are not
excluded, so that the length of a text is an exact sum of frozen table entries.) The language
with the shortest code wins; its score is its share under a softmax of the code lengths, whose
temperature is fitted on documents kept apart from the trees.

Counting, merging and pruning run on executors; the driver gets the finished nodes, whose
size ``model_bytes`` bounds: if they would be larger, contexts must have been seen more often.
More than ``most_languages`` distinct labels raise a ValueError.

Defined results: a null text, or one without a letter, is ``und`` with score 0; if nothing
could be learned (no rows, no labels) every text is ``und``; ties go to the first language by
name; repeated rows give repeated results; very long texts are scored whole, piece by piece;
an empty table gives no rows; other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import Scratch, broadcast, mapped, remembered

ORDER = 4
_PAD = b" "  # stands before a text
_CHUNK = 1 << 17
_MODEL_LIMIT = 64 << 20
_LETTER = re.compile(r"[^\W\d_]")
_TEMPERATURES = np.geomspace(0.5, 64, 43)
_NOISES = np.asarray([1e-5, 1e-4, 1e-3, 0.003, 0.01, 0.02, 0.05, 0.1])


@dataclass
class Model:
    """Nodes are the byte strings in any tree, numbered from 1, by length; 0 is no node."""

    languages: list[str]
    order: int
    first: np.ndarray  # node of each byte
    second: np.ndarray  # node of each pair of bytes
    slots: np.ndarray  # hash table of 256 * parent + byte, for longer strings
    child: np.ndarray  # its node at each slot
    cost: np.ndarray  # by node and language: of its last byte after the others, in bits
    escape: np.ndarray  # by node short enough to be a context
    temperature: float = 5.0


def _hashed(keys: np.ndarray, size: int) -> np.ndarray:
    """Places in a table of ``size``, a power of two: the upper bits of a product."""
    return (keys * np.uint32(0x9E3779B1)) >> np.uint32(33 - size.bit_length())


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table with linear probing, a quarter full at most; no key is 0."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    slots, out = np.zeros(size, np.uint32), np.zeros(size, np.int32)
    keys = keys.astype(np.uint32)
    left, at = np.arange(len(keys)), _hashed(keys, size)
    while len(left):
        free = slots[at] == 0
        slots[at[free]] = keys[left[free]]
        placed = slots[at] == keys[left]
        out[at[placed]] = values[left[placed]]
        left, at = left[~placed], (at[~placed] + np.uint32(1)) & np.uint32(size - 1)
    return slots, out


def build(languages: list[str], grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], order: int) -> Model:
    """A model from ``grams``: by length 1 to ``order`` + 1 the codes, languages and counts of the nodes.

    A code is the string as a big-endian integer. Every node's string without its first byte
    is a node of the same language, too, and so is its string without the last.
    """
    n_lang = len(languages)
    first, second = np.zeros(256, np.int32), np.zeros(1 << 16, np.int32)
    costs, escapes, keys, values = [], [], [], []
    number, shorter, context_of = 1, None, None  # of the next node; of the strings one byte shorter
    for length in range(1, order + 2):
        codes, lang, n = grams.get(length, (np.zeros(0, np.int64),) * 3)
        mine, at = np.unique(codes.astype(np.int64), return_inverse=True)
        count = np.zeros((len(mine), n_lang))
        count[at, lang.astype(np.int64)] = n
        if length == 1:
            parents, prefix, below = 1, np.zeros(len(mine), np.int64), np.full((len(mine), n_lang), 8.0)
            first[mine] = number + np.arange(len(mine))
        else:
            parents, prefix = len(context_of), np.searchsorted(context_of, mine >> 8)
            below = shorter[np.searchsorted(context_of, mine & ((1 << 8 * (length - 1)) - 1))]
            if length == 2:
                second[mine] = number + np.arange(len(mine))
            else:
                keys.append((number - parents + prefix) * 256 + (mine & 255))
                values.append(number + np.arange(len(mine)))
        seen, kinds = np.zeros((parents, n_lang)), np.zeros((parents, n_lang))
        np.add.at(seen, prefix, count)
        np.add.at(kinds, prefix, count > 0)
        whole = np.log2(np.maximum(seen + kinds, 1))
        escape = np.where(kinds > 0, whole - np.log2(np.maximum(kinds, 1)), 0)
        with np.errstate(divide="ignore"):
            cost = np.where(count > 0, whole[prefix] - np.log2(count), escape[prefix] + below)
        if length == 1:
            costs.append(escape + 8.0)  # of a byte that no language has
            escapes.append(np.zeros((1, n_lang)))
        else:
            escapes.append(escape)
        costs.append(cost)
        number, shorter, context_of = number + len(mine), cost, mine
    slots, child = _table(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *values]))
    return Model(languages, order, first, second, slots, child, np.vstack(costs).astype(np.float32), np.vstack(escapes).astype(np.float32))


def _segments(raw: list[bytes], order: int) -> Iterator[tuple[int, bytes]]:
    """Texts in pieces of bounded size: its number, and the piece with the ``order`` bytes before it."""
    for i, b in enumerate(raw):
        for lo in range(0, len(b), _CHUNK):
            before = b[lo - order : lo] if lo >= order else _PAD * (order - lo) + b[:lo]
            yield i, before + b[lo : lo + _CHUNK]


def _grouped(segments: Iterator[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    group, size = [], 0
    for s in segments:
        group.append(s)
        size += len(s[1])
        if size >= _CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _raw(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; nothing for a null."""
    return [b or b"" for b in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


class Scorer:
    def __init__(self, model: Model):
        self.m = model

    def _children(self, keys: np.ndarray) -> np.ndarray:
        m = self.m
        at = _hashed(keys, len(m.slots))
        found = m.slots[at]
        hit = found == keys
        out = m.child[at] * hit
        open_ = np.flatnonzero(~hit & (found != 0))
        at = at[open_]
        while len(open_):
            at = (at + np.uint32(1)) & np.uint32(len(m.slots) - 1)
            found, wanted = m.slots[at], keys[open_]
            hit = found == wanted
            out[open_[hit]] = m.child[at[hit]]
            go_on = ~hit & (found != 0)
            open_, at = open_[go_on], at[go_on]
        return out

    def _costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte under each language, after the bytes before it."""
        m = self.m
        node = m.first[data]  # of the string of the length so far that ends here
        longest = node.copy()
        escapes = []
        for length in range(2, m.order + 2):
            at = np.flatnonzero(node[:-1]) + 1
            context = node[at - 1]
            if length == 2:
                child = m.second[data[at - 1].astype(np.uint16) << np.uint16(8) | data[at]]
            else:
                child = self._children(context.astype(np.uint32) << np.uint32(8) | data[at])
            none = child == 0
            escapes.append((at[none], context[none]))
            node = np.zeros_like(node)
            node[at] = child
            np.copyto(longest, node, where=node > 0)
        cost = m.cost[longest]
        for at, context in escapes:
            cost[at] += m.escape[context]
        return cost

    def bits(self, raw: list[bytes]) -> np.ndarray:
        """Code lengths in bits of every text under every language."""
        order = self.m.order
        out = np.zeros((len(raw), len(self.m.languages)))
        for group in _grouped(_segments(raw, order)):
            ends = np.cumsum([len(b) for _, b in group])
            starts = np.r_[0, ends[:-1]] + order
            cost = self._costs(np.frombuffer(b"".join(b for _, b in group), np.uint8))
            # From each start to its end, and from there to the next start, which is left out.
            bounds = np.column_stack((starts, ends)).ravel()[:-1]
            np.add.at(out, [i for i, _ in group], np.add.reduceat(cost, bounds, axis=0, dtype=np.float64)[::2])
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        m = self.m
        texts = column.to_pylist()
        able = [bool(t and m.languages and _LETTER.search(t)) for t in texts]
        bits = self.bits([b if ok else b"" for b, ok in zip(_raw(column), able)])
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        for i in np.flatnonzero(able):
            best = int(bits[i].argmin())
            names[i] = m.languages[best]
            scores[i] = float(1 / np.exp2(np.maximum((bits[i, best] - bits[i]) / m.temperature, -1000)).sum())
        return names, scores


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def _counter(order: int):
    """Counts of the strings of ``order`` + 1 bytes, by language.

    ``order`` pad bytes count as the beginning of a text, and as many stand before them, so
    that every byte has a full string and shorter strings are suffixes of those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in _slices(batches):
            langs = batch.column("lang").to_numpy()
            for one in set(langs.tolist()):
                mine = totals.setdefault(one, [])
                texts = _raw(batch.column("text").filter(pa.array(langs == one)))
                for group in _grouped(_segments([_PAD * order + b for b in texts if b], order)):
                    data = np.frombuffer(b"".join(b for _, b in group), np.uint8).astype(np.int64)
                    code = np.zeros(len(data), np.int64)
                    for back in range(order + 1):
                        code[back:] |= data[: len(data) - back] << 8 * back
                    counted = np.ones(len(data), bool)
                    starts = np.cumsum([0, *(len(b) for _, b in group[:-1])])
                    for k in range(order):
                        counted[starts + k] = False
                    mine.append(np.unique(code[counted], return_counts=True))
                    if len(mine) >= 32:
                        mine[:] = [_summed(mine)]
        for one, parts in totals.items():
            if parts:
                codes, n = _summed(parts)
                yield pa.RecordBatch.from_pydict({"lang": np.full(len(codes), one, np.int32), "code": codes, "n": n})

    return run


def _nodes(sample: DataFrame, order: int, least_seen: int) -> DataFrame:
    """Strings that are nodes: lang, length, code, n, and how often the string before the last byte was seen."""
    longest = mapped(sample, _counter(order), "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    lengths = longest.select("lang", "n", "code", F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("length"))
    code = F.expr("code & (shiftleft(1L, 8 * length) - 1L)")
    grams = lengths.groupBy("lang", "length", code.alias("code")).agg(F.sum("n").alias("n"))
    often = grams.where((F.col("n") >= least_seen) & (F.col("length") <= order)).select("lang", (F.col("length") + 1).alias("length"), F.col("code").alias("before"), F.col("n").alias("seen"))
    longer = grams.where("length > 1").withColumn("before", F.shiftright("code", 8)).join(often, ["lang", "length", "before"])
    return grams.where("length = 1").select("lang", "length", "code", "n", F.lit(None).cast("long").alias("seen")).unionByName(longer.drop("before"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", row_key: str = "doc_id", rows_per_language: int = 4000, order: int = ORDER, least_seen: int = 4, model_bytes: int = 48 << 20, most_languages: int = 1000) -> Model:
    """Fit trees and temperature on about ``rows_per_language`` whole texts of each language.

    The rows are taken by a hash of their key, alike from every part of the table; an eighth
    of them is kept apart for the temperature.
    """
    spark = df.sparkSession
    df = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(row_key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("name"))
    sizes = {r["name"]: r["n"] for r in df.groupBy("name").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(sizes)
    if not languages:
        return build([], {}, order)
    of = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.struct(F.lit(i).alias("lang"), F.lit(min(1.0, rows_per_language / sizes[k])).alias("share")))])
    drawn = df.withColumn("of", F.element_at(of, F.col("name"))).where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < F.col("of.share") * (1 << 20))
    apart = F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(8)) == 0
    sample = drawn.select("text", "of.lang", apart.alias("apart"))
    scratch = Scratch(spark)
    nodes = scratch.keep(_nodes(sample.where("not apart").select("text", "lang"), order, least_seen))
    # A node has a cost for every language, an escape if it can be a context, and up to eight slots.
    room = min(model_bytes, _MODEL_LIMIT) // (8 * len(languages) + 64)
    by_seen = nodes.where("length > 1").groupBy(F.floor(F.log2("seen")).alias("k")).agg(F.count("*").alias("n")).collect()
    level = max([0, *(r["k"] + 1 for r in by_seen if sum(x["n"] for x in by_seen if x["k"] >= r["k"]) > room)])
    got = nodes.where((F.col("length") == 1) | (F.col("seen") >= max(least_seen, 1 << level if level else 0))).select("lang", "length", "code", "n").toArrow()
    scratch.drop(nodes)
    lengths, code, mine, n = (got.column(c).to_numpy() for c in ("length", "code", "lang", "n"))
    model = build(languages, {k: (code[lengths == k], mine[lengths == k], n[lengths == k]) for k in range(1, order + 2)}, order)
    model.temperature = _temperature(sample.where("apart"), model)
    return model


def _temperature(labelled: DataFrame, model: Model) -> float:
    """The one that makes the labels of documents kept apart most probable; the default without any.

    Some labels are wrong, of long texts, too, whose code lengths leave no doubt. So that
    these do not blur all scores, a share of labels, fitted along, counts as drawn at random.
    """
    shared, key = broadcast(labelled.sparkSession, model, _MODEL_LIMIT), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = remembered(key, lambda: Scorer(shared.value))
        for batch in _slices(batches):
            bits, lang = scorer.bits(_raw(batch.column("text"))), batch.column("lang").to_numpy()
            bits -= bits.min(1, keepdims=True)
            own = bits[np.arange(len(bits)), lang]
            loss = np.zeros((len(_TEMPERATURES), len(_NOISES)))
            for k, t in enumerate(_TEMPERATURES):
                p = np.exp2(-np.minimum(own / t, 1000)) / np.exp2(-np.minimum(bits / t, 1000)).sum(1)
                loss[k] = -np.log2(np.outer(1 - _NOISES, p) + (_NOISES / bits.shape[1])[:, None]).sum(1)
            yield pa.RecordBatch.from_pydict({"k": np.arange(loss.size, dtype=np.int32), "loss": loss.ravel()})

    losses = mapped(labelled.select("text", "lang"), run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    shared.destroy()  # the driver's copy, too
    if not losses:
        return model.temperature
    return float(_TEMPERATURES[min(losses, key=lambda r: (round(r["loss"], 6), r["k"]))["k"] // len(_NOISES)])


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` for each row's whole text."""
    shared, key = broadcast(df.sparkSession, model, _MODEL_LIMIT), uuid.uuid4().hex
    others = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = remembered(key, lambda: Scorer(shared.value))
        for batch in _slices(batches):
            names, scores = scorer.predict(batch.column(text))
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in others} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return mapped(df, run, T.StructType(others + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def remainder(key: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4


def fit(docs: DataFrame) -> Model:
    """Learn from the labelled documents that are not held out."""
    return learn(docs.where(remainder() != 2))


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
