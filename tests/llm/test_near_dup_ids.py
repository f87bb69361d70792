import random

import pytest

from quillspark.llm import near_dup


def _text(rng):
    return [f"w{rng.randrange(10_000)}" for _ in range(200)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_text_of_a_repeated_id_keeps_its_links(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(20):
        # Three texts of one id, each with a near copy of another id.
        for k in range(3):
            words = _text(rng)
            copy = list(words)
            copy[5] = "changed"
            rows += [(i, " ".join(words)), (100 + 3 * i + k, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.query(docs).collect()}
    assert got == {(i, i, True) for i in range(20)} | {(100 + j, j // 3, False) for j in range(60)}
