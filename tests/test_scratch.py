"""Scopes own what is pinned or memoized in them."""

import pytest

from tallyfield.plans import pipeline
from tallyfield.sources import files, scratch


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: str(tmp_path / "scratch"))
    return tmp_path / "scratch"


def left(spark, folder):
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    return sorted(p.name for p in folder.iterdir()) if folder.exists() else [], held


def test_nothing_is_left_behind(spark, folder):
    before = left(spark, folder)
    df = spark.range(100)
    with scratch.scope(spark):
        outer = scratch.pinned(df, "outer")
        with scratch.scope(spark):
            kept = files.memoized(df.selectExpr("id * 2 AS x"))
            assert kept.count() == 100 and scratch.pinned(df, "inner").count() == 100
            assert len(left(spark, folder)[0]) == 2 and left(spark, folder)[1] == before[1] + 1
        assert outer.count() == 100 and len(left(spark, folder)[0]) == 1
    assert left(spark, folder) == ([], before[1])


def test_a_failure_leaves_nothing_either(spark, folder):
    before = left(spark, folder)[1]
    with pytest.raises(ZeroDivisionError), scratch.scope(spark):
        scratch.pinned(spark.range(3), "table")
        files.memoized(spark.range(3)).count()
        scratch.scratch_path(spark, "never-written")
        1 / 0
    assert left(spark, folder) == ([], before)


def test_without_a_scope_tables_stay(spark, folder):
    held = files.memoized(spark.range(3).selectExpr("id + 7 AS y"))
    assert scratch.pinned(held, "table").count() == 3 and len(left(spark, folder)[0]) == 1
    held.unpersist(True)


def test_the_batch_job_cleans_up(spark, folder, tmp_path):
    raw = tmp_path / "a.csv"
    rows = "".join(f"{d:02}-{m:02}-2025,Goa,North,40300{d % 9},{d},2,{m}\n" for m in (1, 2) for d in range(1, 29))
    raw.write_text("date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n" + rows)
    written = pipeline.run(spark, [str(raw)], str(tmp_path / "out"), quick=True)
    assert {"forecast_30day", "milestone_projections"} <= written.keys() and left(spark, folder)[0] == []
