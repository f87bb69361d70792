"""Byte-level BPE encoding and decoding on a sentencepiece model made from a rank file.

The model is serialised straight from the vocabulary: every token's bytes, mapped one to
one to letters, become a piece whose score is the negative rank, so that sentencepiece's
best-score-first merging is the lowest-rank-first merging of byte-level BPE. Normalisation
is the identity. Texts are cut into pre-tokens by a pattern, each pre-token is encoded by
itself, and decoding maps piece strings back to bytes.

Defined results: a null or empty text gives no ids and decodes to no bytes; repeated rows
give repeated results; columns besides the text pass through, except that columns named as
the outputs are replaced. Whole texts are encoded whatever their length.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import BoundedMemory, broadcast, mapped, remembered

# A byte b is the letter U+0100 + b in the pieces: none of these is white space.
_SHIFT = 0x100
_ENTRIES = 80_000  # remembered pre-tokens a generation: at most 32 characters, so 0.5 kB each
_MODEL_LIMIT = 32 << 20
_TEXTS, _CHARACTERS = 256, 1 << 20  # what is encoded together: so many texts or characters, one text at least
# Fixed value: the public pattern that has a quicker form for texts up to U+00FF.
_COMMON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _latin_form(pattern: str) -> str:
    """The pattern with its classes spelt out as far as U+00FF, for the standard library's engine."""
    import unicodedata

    in_class = lambda test: "".join(re.escape(chr(c)) for c in range(256) if test(chr(c)))
    letters = in_class(lambda c: unicodedata.category(c)[0] == "L")
    numbers = in_class(lambda c: unicodedata.category(c)[0] == "N")
    space = in_class(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
    return inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")


_LATIN_PATTERN = _latin_form(_COMMON_PATTERN)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def byte_letters(token: bytes) -> str:
    return "".join(chr(_SHIFT + b) for b in token)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model with piece id = rank; ranks must be 0, 1, ... without gaps."""
    by_rank = sorted(ranks.items(), key=lambda kv: kv[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks have gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    out = bytearray()
    for token, rank in by_rank:
        out += _field(1, _field(1, byte_letters(token).encode()) + _field(2, float(-rank)))
    # The unknown piece that the format asks for; no text reaches it as all bytes have pieces.
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(by_rank)
    out += _field(2, _field(3, 2) + _field(4, n + 1) + _field(40, n))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder over a serialised model; remembers a bounded number of short pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.find_latin = re.compile(_LATIN_PATTERN).findall if pattern == _COMMON_PATTERN else None
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size() - 1)]
        self.bytes_of = [bytes(ord(c) - _SHIFT for c in p) for p in pieces]
        self.id_of = {b: i for i, b in enumerate(self.bytes_of)}
        self.letters = {b: chr(_SHIFT + b) for b in range(256)}
        self.seen = BoundedMemory(lambda token: self._encoded([token])[0], _ENTRIES)

    def _encoded(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens as bytes. (A pre-token in the vocabulary is its own only id.)"""
        raw = [t.encode() for t in tokens]
        whole = list(map(self.id_of.get, raw))
        rest = iter(self.sp.encode([b.decode("latin-1").translate(self.letters) for b, w in zip(raw, whole) if w is None]))
        return [array("I", next(rest) if w is None else (w,)).tobytes() for w in whole]

    def _split(self, text: str) -> list[str]:
        if self.find_latin is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.find(text)
            return self.find_latin(text)
        return self.find(text)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; what is new among a few texts is encoded in one call."""
        split = [self._split(t) for t in texts]
        seen, found, new = self.seen, {}, []
        for t in dict.fromkeys(chain.from_iterable(split)):
            ids = seen.get(t)
            if ids is None:
                ids = seen.old.get(t)
                if ids is None:
                    new.append(t)
                    continue
                seen.hold(t, ids)
            found[t] = ids
        for t, ids in zip(new, self._encoded(new)):
            found[t] = ids
            if len(t) <= seen.longest:
                seen.hold(t, ids)
        get = found.__getitem__
        for tokens in split:
            yield b"".join(map(get, tokens))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""


def _codec(shared, key: int) -> Codec:
    return remembered(("codec", key), lambda: Codec(*shared.value))


def _share(df: DataFrame, vocabulary: str, pattern: str):
    model = serialise(read_ranks(vocabulary))
    return broadcast(df.sparkSession, (model, pattern), _MODEL_LIMIT), hash((vocabulary, pattern, len(model)))


def _with_column(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def _mapped(df: DataFrame, rows, columns: list[T.StructField], step: int = 256) -> DataFrame:
    """``rows(batch)`` gives the new columns of a slice of at most ``step`` rows."""
    names = [c.name for c in columns]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield _with_column(part, rows(part))

    return mapped(df, run, schema)


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """Neighbouring texts in small groups, so that pre-tokens of few texts are in memory at once."""
    group: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if group and (len(group) >= _TEXTS or size + len(t) > _CHARACTERS):
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _id_columns(codec: Codec, batch: pa.RecordBatch, text: str, ids: str) -> dict[str, pa.Array]:
    out = [x for g in _groups(batch.column(text).to_pylist()) for x in codec.encode_all(g)]
    return {ids: pa.array(out, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64())}


def _decoded_column(codec: Codec, column: pa.Array, decoded: str) -> dict[str, pa.Array]:
    return {decoded: pa.array([codec.decode(x or b"") for x in column.to_pylist()], pa.binary())}


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (little-endian unsigned 32-bit, as binary) and ``n_tokens`` for each row's text."""
    shared, key = _share(df, vocabulary, pattern)
    new = [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    return _mapped(df, lambda batch: _id_columns(_codec(shared, key), batch, text, ids), new)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes that a row's ids stand for."""
    shared, key = _share(df, vocabulary, pattern)
    return _mapped(df, lambda batch: _decoded_column(_codec(shared, key), batch.column(ids), decoded), [T.StructField(decoded, T.BinaryType())])


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``decode`` of ``encode``, in one pass of one worker: adds ids, n_tokens and decoded."""
    shared, key = _share(df, vocabulary, pattern)

    def rows(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codec = _codec(shared, key)
        out = _id_columns(codec, batch, text, ids)
        return out | _decoded_column(codec, out[ids], decoded)

    new = [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField(decoded, T.BinaryType())]
    return _mapped(df, rows, new)


def query(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Ids of every whole text and the round trip back to bytes, as digests."""
    back = round_trip(docs.select("doc_id", "text"), vocabulary, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
