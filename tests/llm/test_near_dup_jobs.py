"""What near-dedup asks of the driver: plans, jobs and broadcasts."""

import pytest

near_dup = pytest.importorskip("quillspark.llm.near_dup")
from quillspark.llm._common import Scratch  # noqa: E402


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _kept_plans(monkeypatch):
    """The final plan of every table that is written."""
    plans, keep = [], Scratch.keep

    def noted(self, df):
        out = keep(self, df)
        plans.append(df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")))
        return out

    monkeypatch.setattr(Scratch, "keep", noted)
    return plans


def test_components_broadcast_nothing(spark, monkeypatch):
    plans = _kept_plans(monkeypatch)
    edges = [(1, i) for i in range(2, 50)] + [(i, i + 1) for i in range(100, 140)]
    found = near_dup.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark))
    assert {(r.id, r.root) for r in found.collect()} == {(i, 1) for i in range(1, 50)} | {(i, 100) for i in range(100, 141)}
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_components_of_nothing_take_few_jobs(spark):
    found, jobs = _jobs(spark, "nothing", lambda: near_dup.components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).collect())
    assert found == [] and jobs <= 4


def test_counted_tells_what_was_written(spark):
    scratch = Scratch(spark)
    some, n = scratch.counted(spark.range(10), even=near_dup.F.col("id") % 2 == 0)
    assert n == {"rows": 10, "even": 5} and some.count() == 10
    none, n = scratch.counted(some.where("id < 0").distinct(), even=near_dup.F.col("id") % 2 == 0)
    assert n == {"rows": 0, "even": 0} and none.isEmpty()


def test_star_is_planned_once(spark, make_docs, monkeypatch):
    """No plan of the comparisons holds the search for centres, too."""
    plans = _kept_plans(monkeypatch)
    texts = [" ".join(f"w{k}x{i % 20}" for k in range(60)) + f" end{i}" for i in range(60)]
    found = near_dup.near_duplicates(make_docs(texts), width=2).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 20 for i in range(60)}
    assert max(p.count("Exchange hashpartitioning") for p in plans) <= 14
