import hashlib
import random
import struct

import pyarrow.parquet as pq
import pytest

from quillspark.llm import bpe_codec

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(PATH), special_tokens={})


def _want(oracle, text):
    ids = oracle.encode_ordinary(text or "")
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table_equals_tiktoken(spark, oracle):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = {r[0]: tuple(r[1:]) for r in bpe_codec.query(spark.read.parquet(path), PATH, P.PATTERN).collect()}
    docs = pq.read_table(path).to_pydict()
    assert got == {i: _want(oracle, t) for i, t in zip(docs["doc_id"], docs["text"])}


def test_random_strings_equal_tiktoken(oracle):
    codec = bpe_codec.Codec(bpe_codec.serialise(bpe_codec.read_ranks(PATH)), P.PATTERN)
    rng = random.Random(1)
    alphabet = "ab'stlve  \n\t\x1c\x1f\x85\xa0 éßλЖ日本한🙂́İ_-.12٣<|>" + "".join(map(chr, range(32)))
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = codec.encode(text)
        assert list(memoryview(ids).cast("I") if ids else []) == oracle.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()
    long = "ab" * 50_000
    assert list(memoryview(codec.encode(long)).cast("I")) == oracle.encode_ordinary(long)


def test_odd_rows_and_clashing_columns(odd_docs, oracle):
    from pyspark.sql import functions as F

    out = bpe_codec.decode(bpe_codec.encode(odd_docs.withColumn("ids", F.lit(1)), PATH, P.PATTERN), PATH, P.PATTERN)
    assert {"lang", "source", "ids", "decoded"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) == 9
    for r in rows:
        assert bytes(r.decoded).decode() == (r.text or "")
        assert list(memoryview(bytes(r.ids)).cast("I") if r.ids else []) == oracle.encode_ordinary(r.text or "")
    assert bpe_codec.query(odd_docs.limit(0), PATH, P.PATTERN).count() == 0


def test_gaps_in_ranks_are_an_error():
    with pytest.raises(ValueError):
        bpe_codec.serialise({b"a": 1})
