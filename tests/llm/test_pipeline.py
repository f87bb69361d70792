import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

cp = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage on the small table."""
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for i, (name, f) in enumerate(cp.STAGES):
        f(spark, docs, DIR).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
        out.append({r["doc_id"]: r for r in docs.collect()} if i < len(cp.STAGES) - 1 else docs.collect())
    return out


def _shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_columns_and_filters(stages):
    names = pq.read_schema(f"{DIR}/documents.parquet").names
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality_rules", "near_dedup", "secret_scan", "packing"]
    for rows in stages[:-1]:
        assert list(next(iter(rows.values())).asDict()) == names
    assert len(stages[0]) >= 0.99 * 1000
    labels = pq.read_table(f"{DIR}/labels.parquet").to_pydict()
    good = [i for i, q in zip(labels["doc_id"], labels["quality"]) if q == 1 and i in stages[0]]
    bad = [i for i, q in zip(labels["doc_id"], labels["quality"]) if q == 0 and i in stages[0]]
    long = {i for i, r in stages[0].items() if len(r.text.split()) >= 20}
    assert sum(i in stages[1] for i in good if i in long) >= 0.98 * len([i for i in good if i in long])
    assert sum(i in stages[1] for i in bad) <= 0.15 * len(bad)


def test_dedup_keeps_the_smallest_of_each_group(stages):
    before = {i: _shingles(r.text) for i, r in stages[1].items()}
    ids, root = sorted(before), {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = before[i], before[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    assert set(stages[2]) == {i for i in ids if find(i) == i}


def test_secrets_are_masked_and_nothing_else_changes(stages):
    secret = re.compile(r'(?i)(token = ")[0-9a-f]{40}(?=")')
    assert set(stages[3]) == set(stages[2])
    for i, r in stages[3].items():
        assert r.text == secret.sub(r"\1[SECRET]", stages[2][i].text)
        assert r.n_chars == (len(r.text) if r.text != stages[2][i].text else stages[2][i].n_chars)


def test_packing_holds_every_kept_document(stages):
    assert {r.doc_id for r in stages[4]} == set(stages[3])
    full = Counter()
    for r in stages[4]:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 4096
    assert len(full) <= 1.01 * sum(full.values()) / 4096 + 1


def test_run_equals_the_stages(spark, stages):
    got = {(r.doc_id, r.piece, r.ids_crc32) for r in cp.run(spark, DIR).collect()}
    assert got == {(r.doc_id, r.piece, r.ids_crc32) for r in stages[4]}


def test_stages_take_odd_rows_and_clashing_columns(spark, odd_docs):
    docs = odd_docs.withColumn("score", F.lit("own")).withColumn("kept", F.lit(7))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        assert {(r.score, r.kept) for r in out.collect()} <= {("own", 7)}
        assert stage(spark, docs.limit(0), DIR).count() == 0
    assert cp.STAGES[-1][1](spark, docs.limit(0), DIR).count() == 0


def test_columns_named_like_the_stages_own(spark):
    names = ["_before", "_judged", "_own_kept", "kept", "stats", "base_failed", "lang_pred", "Score", "findings", "_hash", "_bad", "root", "id", "component_id", "n_shingles", "values"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({n: F.lit(f"own {n}") for n in names})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names)
