import __spark_entry__ as e

from quillspark.operators import validation


def test_ranking_is_repeated_ten_times(spark, monkeypatch):
    seen, real = [], validation.stability
    monkeypatch.setattr(validation, "stability", lambda runs, k=5: seen.append(len(runs)) or real(runs, k))
    rows = e.queries()["ranking_stability"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [10]
    assert len(rows) == 5 and all(r.stable for r in rows)
