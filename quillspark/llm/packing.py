"""Best-two-fit packing of token sequences.

A bin is filled greedily with the longest pieces that fit; then its smallest piece gives
way to the two unpacked pieces that fill the widened gap best, if they fill it better.
The decisions depend only on how many pieces of each length are left, so whole runs of
equal bins are decided at once: the plan is made from the histogram of lengths (at most
``capacity`` entries, however many documents there are) and has a bounded number of bin
shapes, each with a multiplicity. Every piece then finds its place from its length and its
rank among the pieces of that length, without any bin being gathered.

Defined results: a null or empty text is a document of the end id alone; repeated rows are
packed as often as they occur; a text of more than ``capacity`` ids is cut into full pieces
and a rest; an empty table gives no rows; further columns of the input are carried through
unless they clash with an output column, which then wins.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import BoundedMemory, Scratch, broadcast, mapped, remembered

_ENTRIES = 100_000  # remembered chunks a generation: at most 32 characters, so 0.5 kB each
_PLAN_LIMIT = 32 << 20
_MARKS = ".,;:!?#$%&*()"
_ENDS = ".,;:!?"
_PYTHON_SPACE = re.compile("[\x1c-\x1f]")
# Letters in this range have one lower-case letter, whatever stands around them.
_LOWERED = re.compile("[\x00-\u012f]*")


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write for the bytes 0 to 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


_KINDS = bytes(ord("." if chr(b) in _ENDS else "a" if b > 127 or chr(b).isalnum() else " " if chr(b).isspace() else "#") for b in range(256))


def _separated(text: str) -> str:
    """The text with white space around sentence marks, if each of them stands alone.

    A mark without another symbol at its side is a pre-token of its own, so white space
    beside it changes no id, and words before marks are the words that stand alone. Texts up
    to U+012F only.
    """
    raw = text.encode()
    # Symbols above U+007F: those up to U+00BF, and the signs of multiplication and division.
    if b"\xc2" in raw or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
        return text
    kinds = raw.translate(_KINDS)
    if b".." in kinds or b".#" in kinds or b"#." in kinds:
        return text
    for mark in _ENDS:
        text = text.replace(mark, f" {mark} ")
    return text


class WordCoder:
    """Ids of a text by the tokenizers library, remembering chunks between white space.

    The tokenizer's normaliser and pre-tokeniser never look across white space, so the ids
    of a text are those of its chunks in turn. A text with U+001C to U+001F, which only
    Python counts as white space, goes to the library whole. ``plain_specials`` reads the
    names of special tokens as plain text; the library's default is their ids.
    """

    def __init__(self, path: str, entries: int = _ENTRIES, plain_specials: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        # What is remembered is remembered here; the model need not do so, too.
        self.tokenizer.model._resize_cache(0)
        merge = self.tokenizer.model.tokenize
        letters = str.maketrans({b: c for b, c in enumerate(_byte_letters())})
        whole = self.whole

        def plain(word: str) -> bytes:
            # Normalised and one pre-token already: only the merges are left.
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(letters)
            return array("I", [t.id for t in merge(word)]).tobytes()

        class Seen(BoundedMemory):
            """A word has one entry in lower case, whatever marks follow it."""

            def __missing__(self, chunk: str) -> bytes:
                if len(chunk) > self.longest:
                    return whole(chunk)
                if not chunk.isalpha():
                    # A run of letters and a run of marks are pre-tokens of their own.
                    body = chunk.rstrip(_MARKS)
                    if len(body) < len(chunk) and body.isalpha() and max(body) < "\u0130":
                        return self[body] + self[chunk[len(body) :]]
                    self.make = whole
                elif chunk.islower() and chunk.isascii():
                    self.make = plain
                elif max(chunk) < "\u0130":
                    # Below U+0130 letters are their own composed form and have one
                    # lower-case letter.
                    low = chunk.lower()
                    if low != chunk:
                        return self[low]
                    self.make = plain
                else:
                    self.make = whole
                return BoundedMemory.__missing__(self, chunk)

        self.seen = Seen(plain, entries)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if _PYTHON_SPACE.search(text):
            return self.whole(text)
        if "<|" not in text and _LOWERED.fullmatch(text):
            text = _separated(text.lower())
        return b"".join(map(self.seen.__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text: str = "text", keep_ids: bool = True, ranks: bool = False, plain_specials: bool = True) -> DataFrame:
    """Tokenise each text, append ``end_id`` and cut what is longer than ``capacity``.

    ``tokenizer`` is the path of a tokenizer file that every executor has. Adds piece,
    start, length, ids_crc32 and, unless ``keep_ids`` is off, the ids as little-endian
    unsigned 32-bit integers; the text is dropped. With ``ranks`` the rows are also those of
    ``ranked``, in the same pass.
    """
    new = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    new += [T.StructField("ids", T.BinaryType())] * keep_ids
    names = {f.name for f in new} | {text, "sequence_id", "offset", "ids"}
    others = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = remembered(("words", tokenizer, plain_specials), lambda: WordCoder(tokenizer, plain_specials=plain_specials))
        encode, end, most = coder.encode, np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                row, piece, start, size, crc, cut = [], [], [], [], [], []
                for i, t in enumerate(batch.column(text).to_pylist()):
                    ids = encode(t or "") + end
                    for k in range(0, len(ids), most):
                        part = ids[k : k + most]
                        row.append(i)
                        piece.append(k // most)
                        start.append(k // 4)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            cut.append(part)
                out = {f.name: batch.column(f.name).take(pa.array(row, pa.int64())) for f in others}
                out |= {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array(cut, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    out = T.StructType(others + new)
    if not ranks:
        return mapped(docs.select(*[f.name for f in others], text), run, out)
    rank, ranked_out = _ranker(out, capacity, "length")
    return mapped(docs.select(*[f.name for f in others], text), lambda batches: rank(run(batches)), ranked_out)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin shapes ``(multiplicity, [(length, how many per bin), ...])`` that use up ``counts``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not from 1 to {capacity}")
        left[length] = n
    bins = []
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return bins
        have, shape, gap, at = left.copy(), {}, capacity, top
        while gap and at:
            fits = np.flatnonzero(have[1 : min(at, gap) + 1])
            if not len(fits):
                break
            at = int(fits[-1]) + 1
            n = min(int(have[at]), gap // at)
            shape[at] = n
            have[at] -= n
            gap -= n * at
            at -= 1
        needed = shape.copy()
        if gap and (pair := _two_for_one(have, gap, min(shape))):
            shape[min(needed)] -= 1
            for x in pair:
                shape[x] = shape.get(x, 0) + 1
                needed[x] = needed.get(x, 0) + 1
        shape = {x: n for x, n in shape.items() if n}
        # The next bin is decided alike while all that this one chose from is still there.
        times = 1 + min((int(left[x]) - needed[x]) // n for x, n in shape.items())
        for x, n in shape.items():
            left[x] -= times * n
        bins.append((times, sorted(shape.items(), reverse=True)))


def _two_for_one(have: np.ndarray, gap: int, smallest: int) -> tuple[int, int] | None:
    """The two free lengths that fill ``gap + smallest`` best and better than ``smallest`` does.

    Of equally good pairs, that with the shortest piece.
    """
    room = gap + smallest
    first = np.flatnonzero(have[: min(room, len(have))])
    first = first[first > 0]
    if not len(first):
        return None
    at = np.searchsorted(first, room - first, side="right") - 1
    ok = at >= 0
    second = np.where(ok, first[at], 0)
    lone = ok & (second == first) & (have[first] < 2)
    second = np.where(lone, np.where(at > 0, first[np.maximum(at - 1, 0)], 0), second)
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    return (int(first[best]), int(second[best])) if total[best] > smallest else None


def _places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on, in which first bin, how many per bin, at what offset."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for times, shape in bins:
        offset = 0
        for length, n in shape:
            rows.setdefault(length, []).append((used.get(length, 0), first, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        first += times
    return {k: tuple(np.asarray(x, np.int64) for x in zip(*v)) for k, v in rows.items()}


def _ranker(schema: T.StructType, capacity: int, length: str):
    others = [f for f in schema.fields if f.name not in ("_task", "_nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        task = int.from_bytes(os.urandom(8), "little") >> 1
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            size = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(size, kind="stable")
            runs = size[order]
            start = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]][: len(runs)])
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(runs)) - np.repeat(start, np.diff(np.r_[start, len(runs)]))
            nth += seen[size]
            np.add.at(seen, size, 1)
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in others} | {"_task": np.full(len(size), task), "_nth": nth})

    return run, T.StructType(others + [T.StructField("_task", T.LongType()), T.StructField("_nth", T.LongType())])


def ranked(parts: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Add ``_task``, a random number of the task, and ``_nth``, the rank among its rows of a length.

    Only meaningful once written to a table: the numbers are then data, whatever is run again.
    """
    return mapped(parts, *_ranker(parts.schema, capacity, length))


def assign(parts: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Add sequence_id and offset to a written table of ``ranked`` rows with ``length`` from 1 to ``capacity``.

    What the driver gets is the histogram of lengths, at most ``capacity`` rows; what it
    sends is the plan, whose size depends on ``capacity`` and is checked.
    """
    by_task = parts.groupBy("_task", length).agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in parts.groupBy(length).agg(F.count("*")).toLocalIterator()}
    shared = broadcast(parts.sparkSession, _places(plan_bins(counts, capacity)), _PLAN_LIMIT)
    before = Window.partitionBy(length).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("_task", length, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    others = [f for f in parts.schema.fields if f.name not in ("_task", "_nth", "sequence_id", "offset")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            size, at = (batch.column(n).to_numpy(zero_copy_only=False) for n in (length, "_at"))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(size) else ():
                one = int(size[mine[0]])
                begin, first, n, off = places[one]
                k = np.searchsorted(begin, at[mine], side="right") - 1
                nth = at[mine] - begin[k]
                sequence[mine] = first[k] + nth // n[k]
                offset[mine] = off[k] + nth % n[k] * one
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in others} | {"sequence_id": sequence, "offset": offset})

    final = T.StructType(others + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = (F.col("_nth") + F.col("_before")).alias("_at")
    return mapped(parts.join(base, ["_task", length]).select(*[f.name for f in others], at), place, final)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", keep_ids: bool = True, plain_specials: bool = True) -> DataFrame:
    """Pack every document of ``docs``; one row per piece with its sequence and offset."""
    cut = pieces(docs, tokenizer, capacity, end_id, text, keep_ids, ranks=True, plain_specials=plain_specials)
    return assign(Scratch(docs.sparkSession).keep(cut), capacity)


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    out = pack(docs.select("doc_id", "text"), tokenizer, keep_ids=False, plain_specials=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
