import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions.analysis import LETTERS
from quillspark.operators import codec, index
from quillspark.sources import binary

DIR = "/root/testdata/sf0.01"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=40))
def test_varints(values):
    assert binary.from_varints(binary.varints(np.asarray(values, np.uint64))).tolist() == values
    assert binary.varints(np.asarray(values, np.uint64)) == b"".join(map(binary._varint, values))


def _stored(spark, path, rows, kind="long", parts=3):
    df = spark.createDataFrame(rows, f"term string, doc_id {kind}")
    # Small tables would be put together into one partition.
    held = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        binary.write_binary(df, path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return binary.read_binary(spark, path)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_round_trip(spark, tmp_path, kind):
    rng = random.Random(1)
    terms = ["", "a", "aa", "ab", "é", "\U0001f600", "z" * 300] + ["t" + str(i) for i in range(500)]
    rows = {(t, rng.choice((i, -i, 2**62 + i, -(2**62) - i))) for t in terms for i in range(rng.choice((1, 2, 9, 3000 if t == "ab" else 3)))}
    rows = [(t, i if kind == "long" else f"mail/{i}.txt") for t, i in rows]
    back = _stored(spark, f"{tmp_path}/i", rows, kind)
    assert back.dtypes == [("term", "string"), ("doc_id", "bigint" if kind == "long" else "string")]
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    for t in ("", "ab", "\U0001f600", "t17", "nosuchterm", "zz"):
        assert sorted(r.doc_id for r in back.where(F.col("term") == t).collect()) == sorted(i for u, i in rows if u == t)
    some = ["ab", "t3", "nosuch", "t499"]
    assert sorted(map(tuple, back.where(F.col("term").isin(some) & F.col("doc_id").isNotNull()).collect())) == sorted(r for r in rows if r[0] in some)
    assert back.where("term = 'a' and term = 'ab'").count() == 0


def test_empty_and_replaced(spark, tmp_path):
    path = f"{tmp_path}/i"
    assert _stored(spark, path, []).count() == 0
    assert _stored(spark, path, [("a", 1)]).count() == 1
    assert _stored(spark, path, [("b", 2), ("b", 3)]).where("term = 'a'").count() == 0
    assert len(list(tmp_path.glob("i/*.bin"))) == len(binary.read_manifest(path)["parts"])
    (tmp_path / "i" / "part-left-over.bin").write_bytes(b"of a lost task")
    assert binary.read_binary(spark, path).count() == 2


def test_a_look_up_reads_little(spark, tmp_path):
    postings = index.count_postings(spark.read.parquet(f"{DIR}/documents.parquet"), LETTERS).select("term", "doc_id").cache()
    path = f"{tmp_path}/i"
    binary.write_binary(postings, path)
    want: dict = {}
    for r in postings.collect():
        want.setdefault(r.term, []).append(r.doc_id)
    manifest, every = binary.read_manifest(path), binary.stored_bytes(path)
    assert every == sum(f.stat().st_size for f in (tmp_path / "i").glob("*.bin"))
    rng = random.Random(2)
    for p in manifest["parts"]:
        here = sorted(t for t in want if p["first"] <= t <= p["last"])
        for t in rng.sample(here, 40):
            with binary.Part(path, p["name"], True) as part:
                found = [i for ids in part.find(t.encode()) for i in ids]
                assert set(found) <= set(want[t]) and (len(found) == len(want[t]) or t in (p["first"], p["last"]))
                # Two searches, the table's rows, two blocks and what the list itself takes.
                probes = 2 * (p["blocks"].bit_length() + 1) * (binary._TABLE.size + 64)
                assert part.bytes_read < probes + 2 * 256 * binary._TABLE.size + 3 * binary.BLOCK_BYTES + 3 * len(found)
    some = rng.sample(sorted(want), 2000)
    looked = binary.read_binary(spark, path).where(F.col("term").isin(some))
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, looked.collect())) == sorted((t, i) for t in some for i in want[t])
    assert " Filter " not in plan
    fixed = codec.size_report(postings).first()
    assert fixed.compressed_size / every > 2 and fixed.original_size / every > 1.5


def test_a_frequent_term_has_many_parts(spark, tmp_path):
    rows = [("every", i) for i in range(60_000)] + [(w, i) for i in range(40) for w in ("even", "ever", "everyone")]
    back = _stored(spark, f"{tmp_path}/i", rows, parts=12)
    parts = binary.read_manifest(f"{tmp_path}/i")["parts"]
    assert sum(p["first"] <= "every" <= p["last"] for p in parts) >= 10
    assert sorted(r.doc_id for r in back.where("term = 'every'").collect()) == list(range(60_000))
