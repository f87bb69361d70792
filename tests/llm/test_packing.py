import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def _ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def _hold(rows, want, capacity=4096):
    """Pieces are the documents' ids in order; every sequence is gapless and within capacity."""
    got, sequences = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    crc = lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes())
    for doc, ids in want.items():
        assert sorted(got[doc]) == [(k, k * capacity, len(c), crc(c)) for k in range(-(-len(ids) // capacity)) for c in [ids[k * capacity : (k + 1) * capacity]]], doc
    assert set(got) == set(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = pq.read_table(path).to_pydict()
    want = dict(zip(docs["doc_id"], _ids(docs["text"])))
    n = _hold(packing.query(spark.read.parquet(path), PATH).collect(), want)
    assert n <= 1.01 * -(-sum(map(len, want.values())) // 4096) + 1


def test_odd_rows(odd_docs):
    rows = packing.pack(odd_docs.where("doc_id is null or doc_id <> 6"), PATH).collect()
    plain = odd_docs.where("doc_id is null or doc_id <> 6").collect()
    _hold(rows, dict(zip([r.doc_id for r in plain], _ids([r.text for r in plain]))))
    assert packing.pack(odd_docs.where("doc_id = 6"), PATH).count() == 2
    assert {"lang", "source", "ids"} <= set(packing.pack(odd_docs, PATH).columns)
    assert packing.query(odd_docs.limit(0), PATH).count() == 0
    clash = packing.pack(odd_docs.withColumn("piece", F.lit("own")).withColumn("offset", F.lit("own")), PATH)
    assert len(clash.columns) == len(set(clash.columns)) and not clash.where("cast(piece as string) = 'own'").count()


def _one_by_one(lengths, capacity):
    """The rule applied bin by bin to single documents."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        mine, gap = [], capacity
        for x in list(left):
            if x <= gap:
                mine.append(x)
                left.remove(x)
                gap -= x
        small = mine[-1]
        pairs = [(left[j], left[i]) for i in range(len(left)) for j in range(i) if small < left[i] + left[j] <= gap + small]
        if gap and pairs:
            # The fullest; of equal ones that with the shortest piece.
            best = min(pairs, key=lambda p: (-sum(p), min(p)))
            mine.remove(small)
            for x in best:
                left.remove(x)
            left = sorted([*left, small], reverse=True)
            mine += best
        bins.append(tuple(sorted(mine, reverse=True)))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.lists(st.integers(1, 40), max_size=40), st.lists(st.integers(1, 6), max_size=60), st.lists(st.integers(9, 21), max_size=60)))
def test_plan_is_the_rule_for_single_documents(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    got = [tuple(sorted((x for x, n in shape for _ in range(n)), reverse=True)) for times, shape in packing.plan_bins(counts, 40) for _ in range(times)]
    assert got == _one_by_one(lengths, 40)


def test_plan_size_does_not_follow_the_counts():
    rng = np.random.default_rng(0)
    counts = {int(x): int(n) for x, n in zip(range(1, 4097), rng.integers(1, 10**9, 4096))}
    bins = packing.plan_bins(counts, 4096)
    total = sum(x * n for x, n in counts.items())
    assert len(bins) < 40_000
    assert sum(t for t, _ in bins) < 1.005 * total / 4096 + 4096


def test_coder_equals_library():
    import random

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    coder = packing.WordCoder(PATH, entries=50)
    rng = random.Random(2)
    alphabet = "abXYZ'stlve  \n\t\x1c\x85\xa0éÉßΣσЖ日한🙂́İÅ.,_12<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("aéßÜñç") for _ in range(rng.randint(1, 12))) + rng.choice(["", "###", ".%%%", ",***", "!!", "'s", "('ll"]) for _ in range(2000)]
    for text, ids in zip(texts, _ids(texts)):
        assert coder.encode(text) == np.asarray(ids[:-1], "<u4").tobytes(), repr(text)
