"""Incremental refresh and the headers of many shards."""

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import aggregate, clean
from tallyfield.plans import refresh as r
from tallyfield.sources import files

HEAD = "date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n"


def lines(month, n, place="North", start=1):
    return "".join(f"{d:02}-{month:02}-2025,Goa,{place},40300{d % 9},1,2,{d}\n" for d in range(start, start + n))


def written(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def of(files_, month):
    return {p: t for p, t in files_.items() if f"month={month}/" in str(p)}


def check(spark, raw, facts, rollups):
    """The tables are what cleaning everything at once gives."""
    whole = clean.clean(files.read_raw_csv(spark, [str(raw / "*.csv")]))
    for ours, theirs in ((facts, whole), (rollups.cube, aggregate.day_cube(whole)), (rollups.pincodes, aggregate.pincode_profile(whole))):
        names = sorted(theirs.columns)
        assert sorted(ours.columns) == names
        assert sorted(map(str, ours.select(names).collect())) == sorted(map(str, theirs.select(names).collect()))


def test_shards_come_change_and_go(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "a.csv").write_text(HEAD + lines(1, 20) + lines(2, 9))
    (raw / "b.csv").write_text(HEAD + lines(2, 9, "South") + lines(1, 3))  # the rows of January are also in a
    go = lambda: r.refresh(spark, str(raw / "*.csv"), str(out))
    check(spark, raw, *go())
    first = written(out / "clean")
    check(spark, raw, *go())
    assert written(out / "clean") == first  # nothing to do
    (raw / "c.csv").write_text(HEAD + lines(2, 4, "South") + lines(3, 7) + "31-02-2025,Goa,North,403001,1,2,3\n")
    check(spark, raw, *go())
    second = written(out / "clean")
    assert of(second, 1) == of(first, 1) != {} and of(second, 2) != of(first, 2) and of(second, 3)
    cubes = written(out / "rollups")
    (raw / "a.csv").write_text(HEAD + lines(1, 20) + lines(2, 8) + lines(5, 2))  # changed: a day of February less, May new
    check(spark, raw, *go())
    third = written(out / "clean")
    assert of(third, 3) == of(second, 3) and of(written(out / "rollups"), 3) == of(cubes, 3) and of(third, 5)
    (raw / "c.csv").unlink()  # March is empty now
    facts, rollups = go()
    check(spark, raw, facts, rollups)
    assert facts.where("month = 3").count() == 0
    (raw / "d.csv").write_text(HEAD + lines(3, 2, "East"))
    check(spark, raw, *go())


def test_a_refresh_cut_short_is_done_again(spark, tmp_path, monkeypatch):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "a.csv").write_text(HEAD + lines(1, 20))
    r.refresh(spark, str(raw / "*.csv"), str(out))
    (raw / "b.csv").write_text(HEAD + lines(1, 5, "South") + lines(4, 5))
    with monkeypatch.context() as broken:
        broken.setattr(r.aggregate, "day_cube", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            r.refresh(spark, str(raw / "*.csv"), str(out))
    (raw / "b.csv").unlink()  # its rows are in the facts already, and no manifest knows it
    check(spark, raw, *r.refresh(spark, str(raw / "*.csv"), str(out)))


def test_no_rows_at_all(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text(HEAD + "31-02-2025,Goa,North,403001,1,2,3\n")
    facts, rollups = r.refresh(spark, str(raw / "*.csv"), str(tmp_path / "out"))
    assert facts.count() == rollups.cube.count() == rollups.pincodes.count() == 0
    (raw / "b.csv").write_text(HEAD + lines(1, 2))
    check(spark, raw, *r.refresh(spark, str(raw / "*.csv"), str(tmp_path / "out")))


def test_many_shards_take_few_jobs(spark, tmp_path):
    folder = tmp_path / "odd name+%20"
    folder.mkdir()
    for k in range(1000):
        head = HEAD if k % 2 else 'date,"state",district,age_0_5\n'
        (folder / f"s {k}.csv").write_text(head + ("01-01-2025,Goa,North,403001,1,2,3\n" if k % 2 else '02-01-2025,Goa,"So ""u"" th, x",7\n'))
    (folder / "empty.csv").write_text("")
    (folder / "headonly.csv").write_text("﻿" + HEAD)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        raw = files.read_raw_csv(spark, str(folder))
        jobs = len(tracker.getJobIdsForGroup("headers"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6
    assert {(x.date, x.district, x.pincode, x["count"]) for x in raw.groupBy("date", "district", "pincode").count().collect()} == {
        ("01-01-2025", "North", "403001", 500), ("02-01-2025", 'So "u" th, x', None, 500),
    }


def test_a_large_shard_is_not_read_for_its_header(spark, tmp_path):
    body = HEAD + lines(1, 28) * 4000
    (tmp_path / "big.csv").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(body) // 5))
    try:
        got = files.shard_headers(spark, [str(tmp_path)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(x.path.rsplit("/", 1)[1], x.header) for x in got] == [("big.csv", HEAD.strip().split(","))]
    raw = files.read_raw_csv(spark, str(tmp_path), shard="version")
    assert raw.count() == 28 * 4000 and raw.select("version").distinct().count() == 1
    assert raw.select(F.first("version")).first()[0] == files.shard_versions(spark, [str(tmp_path)]).first().shard
