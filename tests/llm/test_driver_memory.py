"""What a learned model takes of the driver while it is broadcast."""

import tracemalloc

import numpy as np
import pytest

langid = pytest.importorskip("quillspark.llm.langid")
from quillspark.llm import _common  # noqa: E402


def test_size_of_a_model_is_measured_without_its_pickle(spark):
    model = {i: np.full(1 << 20, i, np.uint8) for i in range(32)}
    tracemalloc.start()
    try:
        shared = _common.broadcast(spark, model, 64 << 20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 << 20
    assert {i: a.sum() for i, a in shared.value.items()} == {i: i << 20 for i in range(32)}
    shared.destroy()


@pytest.mark.parametrize("more", [0, 1])
def test_bound_is_that_of_the_pickle(spark, more):
    value = b"x" * 100_000
    limit = len(_common.cloudpickle.dumps(value)) - more
    if more:
        with pytest.raises(ValueError, match=f"model of {limit + 1} bytes"):
            _common.broadcast(spark, value, limit)
    else:
        assert _common.broadcast(spark, value, limit).value == value


def test_fit_leaves_no_model_in_the_driver(spark, make_docs, monkeypatch):
    made = []

    def noted(*args):
        made.append(_common.broadcast(*args))
        return made[-1]

    monkeypatch.setattr(langid, "broadcast", noted)
    docs = make_docs([f"the house number {i} of the street" if i % 2 else f"das haus nummer {i} der strasse" for i in range(80)])
    docs = docs.withColumn("lang", langid.F.when(langid.F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    langid.fit(docs)
    assert made and not any(b._jbroadcast.isValid() for b in made)
