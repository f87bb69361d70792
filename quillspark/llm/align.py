"""Alignment of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model with
byte fallback. Both read a space and the text. A two-pointer merge of the cumulative token
ends gives groups, cut where tokens of both end, and links, the A-B pairs of tokens whose
bytes overlap. Spark counts how often each pair of ids is linked in the corpus, finds each
id's highest count, and brings both back to the texts.

Both tokenizers begin a new token where white space follows other text, unless a vocabulary
has pieces across such places; so a text is aligned in chunks, and a chunk that comes again
is remembered. Texts with characters that libraries do not agree on as white space, and
models without that property, go to the libraries whole. A merge within a chunk is the
merge of the whole text, as both have an end before it.

Defined results: texts null or empty, or which either tokenizer does not give back byte by
byte, have no tokens: counts are 0 and groups is empty. Special tokens inside texts are plain
text. Repeated rows and ids are rows of their own, a null id stays null; an empty table gives
no rows. Only the id is carried along, as pandas would turn other columns' nulls into other
values. Very long texts are aligned whole.

At scale: counts are added up per task before they move. The most frequent pairs, of at most
``head`` in number, are broadcast, the rest meet their links by a shuffle; no rest pair is
hot, as each comes less often than any of the head.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import BoundedMemory, Scratch, bound_batches, remembered
from quillspark.llm.packing import _byte_letters

_ENTRIES = 200_000  # remembered chunks a generation: at most 32 characters, so 0.3 kB each
_CHARACTERS = 1 << 20  # of the texts that are aligned together: so many, one text at least
_HEAD = 400_000  # pairs that are broadcast: 64 bytes each in a hash table
_MARK = "\u2581"
# White space and what follows, up to a space or line feed after another character.
_CHUNK = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
# White space to some of the engines only.
_ODD = re.compile("[\x1c-\x1f\u180e]")
# A line feed, a word of letters up to U+024F with its space, marks but for apostrophes.
_WORD = re.compile("(\n?)( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


class Aligner:
    """Alignment of whole texts by two tokenizer files."""

    def __init__(self, path_a: str, path_b: str, entries: int = _ENTRIES):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.model._resize_cache(0)  # what is remembered is remembered here
        letters = _byte_letters()
        self.letters = str.maketrans(dict(enumerate(letters)))
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if all(c in byte_of for c in token):
                self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.b = SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(_MARK, " ").encode()
            for i, p in enumerate(names)]
        self.space = names.index(_MARK) if _MARK in names else None
        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        self.words_a = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        with open(path_b, "rb") as f:
            rules = proto.ModelProto.FromString(f.read()).normalizer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and not rules.remove_extra_whitespaces
        self.in_chunks = bool(self.words_a and plain and self.space is not None and not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in names))
        self.seen = BoundedMemory(None, entries)

    def _ids_a(self, chunk: str) -> list[int]:
        parts = _WORD.fullmatch(chunk) if self.words_a else None
        if parts is None:
            return self.a.encode(chunk, add_special_tokens=False).ids
        # A line feed, a word and marks are pre-tokens: only the merges are left.
        merge, raw = self.a.model.tokenize, chunk.encode().decode("latin-1").translate(self.letters)
        if parts.end(2) == len(chunk) and not parts[1]:
            return [t.id for t in merge(raw)]
        marks = len(parts[3])
        pieces = (raw[: len(parts[1])], raw[len(parts[1]) : len(raw) - marks], raw[len(raw) - marks :])
        return [t.id for x in pieces if x for t in merge(x)]

    def _ids_b(self, chunks: list[str]) -> list[list[int]]:
        """B adds the space that chunks begin with; where one begins otherwise, it is taken off again."""
        ids = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [(i or [self.space]) if c[0] == " " else i[1:] for c, i in zip(chunks, ids)]

    def aligned(self, chunk: str, b: list[int]) -> tuple[bytes, bytes, int] | None:
        """(groups, links, number of A tokens) of a chunk with its ids of B; links are A id << 32 | B id as 64-bit integers."""
        a, raw = self._ids_a(chunk), chunk.encode()
        bytes_a, bytes_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        more_a, more_b = zip(a[1:], map(len, bytes_a[1:])), zip(b[1:], map(len, bytes_b[1:]))
        of_a, of_b, end_a, end_b, last = a[0], b[0], len(bytes_a[0]), len(bytes_b[0]), len(raw)
        links, groups, names_a, names_b = array("Q"), [], str(of_a), str(of_b)
        while True:
            links.append(of_a << 32 | of_b)
            if end_a == end_b:
                groups.append(names_a + "|" + names_b)
                if end_a == last:
                    break
                (of_a, size_a), (of_b, size_b) = next(more_a), next(more_b)
                end_a, end_b, names_a, names_b = end_a + size_a, end_b + size_b, str(of_a), str(of_b)
            elif end_a < end_b:
                of_a, size_a = next(more_a)
                end_a, names_a = end_a + size_a, f"{names_a},{of_a}"
            else:
                of_b, size_b = next(more_b)
                end_b, names_b = end_b + size_b, f"{names_b},{of_b}"
        return ";".join(groups).encode(), links.tobytes(), len(a)

    def align_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, int]]:
        """(groups, links, number of A tokens) of each text; what is new among a few texts goes to B in one call."""
        split = []
        for t in texts:
            whole = not self.in_chunks or (t and _ODD.search(t))
            split.append([] if not t else [" " + t] if whole else _CHUNK.findall(" " + t))
        seen, found, new = self.seen, {}, []
        for c in dict.fromkeys(chain.from_iterable(split)):
            known = seen.get(c, seen)
            if known is seen:
                known = seen.old.get(c, seen)
                if known is seen:
                    new.append(c)
                    continue
                seen.hold(c, known)
            found[c] = known
        for c, b in zip(new, self._ids_b(new)):
            found[c] = known = self.aligned(c, b)
            if len(c) <= seen.longest:
                seen.hold(c, known)
        get = found.__getitem__
        for chunks in split:
            parts = list(map(get, chunks))
            if None in parts:
                parts = []
            yield b";".join([x[0] for x in parts]), b"".join([x[1] for x in parts]), sum([x[2] for x in parts])


def _groups(texts: list[str | None]) -> Iterator[slice]:
    """Slices of neighbouring texts."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > _CHARACTERS:
            yield slice(first, i)
            first, size = i, 0
        size += n
    if first < len(texts):
        yield slice(first, len(texts))


_SCHEMA = "id string, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each row.

    ``groups`` is like ``a1,a2|b1;a3|b2``: ids of A and of B, group by group. ``pairs`` has
    each linked pair of ids once, as A id << 32 | B id, and ``times`` how many links it has
    in the text. The paths are of tokenizer files that every executor has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = remembered(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        for frame in frames:
            ids, texts = frame["id"].tolist(), frame["text"].tolist()
            for at in _groups(texts):
                rows = []
                for i, (groups, raw, n_a) in zip(ids[at], aligner.align_all(texts[at])):
                    links = np.frombuffer(raw, np.int64)
                    pairs, times = np.unique(links, return_counts=True)
                    n_groups = groups.count(b"|")
                    # A link ends where a token of either ends, a group where tokens of both do.
                    rows.append((i, n_a, len(links) + n_groups - n_a, n_groups, len(links), groups.decode(), pairs, times))
                yield pd.DataFrame(rows, columns=columns)

    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    kind = dict(docs.dtypes)[doc_id]
    found = bound_batches(docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))).mapInPandas(run, _SCHEMA)
    return found.withColumn("id", F.col("id").cast(kind))


def id_a(pair: Column) -> Column:
    return F.shiftright(pair, 32)


def id_b(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit((1 << 32) - 1))


def _links(texts: DataFrame, *keys: str) -> DataFrame:
    """(pair, times) of each text, and its ``keys``."""
    rows = texts.select(*keys, F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    return rows.select(*keys, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def link_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best_a, best_b): links of each pair of ids in all texts, and the highest count of its A and of its B id."""
    counts = _links(texts).groupBy("pair").agg(F.sum("times").alias("n"))
    counts = Scratch(texts.sparkSession).keep(counts)
    sides = counts.select("pair", "n", id_a(F.col("pair")).alias("a"), id_b(F.col("pair")).alias("b"))
    best_a = sides.groupBy("a").agg(F.max("n").alias("best_a"))
    best_b = sides.groupBy("b").agg(F.max("n").alias("best_b"))
    return sides.join(best_a, "a").join(best_b, "b").select("pair", "n", "best_a", "best_b")


def _least_of_head(counts: DataFrame, head: int) -> int:
    """A power of two that at most ``head`` counts reach."""
    per_bit = {r["bit"]: r["count"] for r in counts.groupBy(F.length(F.bin("n")).alias("bit")).count().collect()}
    bit = max(per_bit, default=0) + 1
    while bit > 1 and (head := head - per_bit.get(bit - 1, 0)) >= 0:
        bit -= 1
    return 1 << bit >> 1


def with_counts(texts: DataFrame, counts: DataFrame, row: str, head: int = _HEAD) -> DataFrame:
    """(``row``, n_best_a, n_best_b, count_sum): how many links of a text have their id's highest count, and the sum of all links' counts.

    ``row`` tells the texts apart. Texts without links have no row.
    """
    least = _least_of_head(counts, head)
    links = _links(texts, row)
    frequent = F.broadcast(counts.where(F.col("n") >= least))
    found = links.join(frequent, "pair")
    rest = counts.where(F.col("n") < least)
    if least > 1:
        found = found.unionByName(links.join(frequent.select("pair"), "pair", "left_anti").join(rest, "pair"))
    own = lambda best: F.sum(F.when(F.col("n") == F.col(best), F.col("times")).otherwise(0))
    return found.groupBy(row).agg(own("best_a").alias("n_best_a"), own("best_b").alias("n_best_b"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def query(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Alignment of every whole text, its groups as a digest, and what the corpus says of its links."""
    scratch = Scratch(docs.sparkSession)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    texts = aligned(docs, path_a, path_b).select("id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times")
    texts = scratch.keep(texts.withColumn("row", F.monotonically_increasing_id()))
    counts = scratch.keep(link_counts(texts))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return texts.drop("pairs", "times").join(with_counts(texts, counts, "row"), "row", "left").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", zero(F.col("n_best_b")).alias("n_best"), zero(F.col("count_sum")).alias("count_sum"), "groups_sha256")
