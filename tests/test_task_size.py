"""Work of one task that does not grow with the tables."""

from __future__ import annotations

import datetime as dt

from tallyfield.operators import aggregate, kmeans, learn, segment
from tallyfield.plans import reports
from tallyfield.sources import tables

DAY = dt.date(1995, 1, 1)


def order_tables(spark, folder, lines):
    """Order tables in ``folder`` from (customer, days after 1995-01-01 or None, flag, quantity); a customer has one order."""
    customers = sorted({c for c, *_ in lines if c > 0})
    made = {
        "lineitem": ([(c, d if d is None else DAY + dt.timedelta(d), f, q) for c, d, f, q in lines], "l_orderkey long, l_shipdate date, l_returnflag string, l_quantity double"),
        "orders": ([(c, c) for c in customers] + [(-1, None)], "o_orderkey long, o_custkey long"),
        "customer": ([(c, c % 2, "AUTO" if c % 3 else None) for c in customers], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "A"), (1, "B")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_records_are_summed_in_more_tasks_as_lines_grow(spark, tmp_path, monkeypatch):
    lines = [(c, None if c == 7 else (c * 37 + i // 2 * 200), "RAN"[i % 3], float(i)) for c in range(1, 31) for i in range(8)]
    lines += [(1, i * 6, "R", 1.0) for i in range(400)] + [(-1, 3, "R", 5.0), (99, None, None, None)]
    folder = order_tables(spark, tmp_path, lines)
    monkeypatch.setattr(tables, "LINES", 10)
    got = tables.activity(spark, folder)
    assert got.rdd.getNumPartitions() >= len(lines) / 10
    per_task = got.rdd.glom().map(len).collect()
    assert max(per_task) < got.count() / 2, "a customer with most lines is spread by years"

    want: dict[tuple, list] = {}
    for c, d, f, q in lines:
        if c > 0:
            day = None if d is None else DAY + dt.timedelta(d)
            row = want.setdefault((day, "AB"[c % 2], f"{'AB'[c % 2]}/AUTO" if c % 3 else None, str(100000 + c)), [None] * 4)
            for at, v in enumerate([q if f == x else 0 for x in "RAN"] + [q]):
                row[at] = row[at] if v is None else (row[at] or 0) + int(v)
    assert {tuple(r[:4]): list(r[4:]) for r in got.collect()} == want


def test_pincode_profile_counts_days_without_a_distinct_count(spark):
    A = tables.ACTIVITY
    rows = [
        ("A", "A/x", "1", DAY + dt.timedelta(d), d, 0, None, d) for d in (0, 0, 1, 364, 365, 366, 900)
    ] + [("A", "A/x", "1", None, 1, 1, None, 4), ("B", "B/x", "1", None, 1, 1, 1, None), (None, "B/x", "2", DAY, 1, 1, 1, 3), ("B", "B/x", None, DAY, 1, 1, 1, 3)]
    facts = spark.createDataFrame(rows, "state string, district string, pincode string, date date, part_a long, part_b long, part_c long, total long")
    got = aggregate.pincode_profile(facts, A)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower()
    assert sorted(map(tuple, got.select("pincode", "state", "district", "part_a", "part_c", "total", "active_days").collect()), key=str) == [
        ("1", "A", "A/x", 1997, None, 2000, 6), ("1", "B", "B/x", 1, 1, None, 0),
    ]


def test_hashes_of_many_keys_are_those_of_each():
    keys = [f"1000{i}|Ä|ß{i * i}" for i in range(500)] + [""]
    got = kmeans.lucks(42, 3, 1, [k.encode() for k in keys])
    assert got.tolist() == [kmeans.luck(42, 3, 1, k) for k in keys]


def test_reports_fit_only_what_is_asked_for(facts, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("no section asks for this")

    r = reports.Rollups(aggregate.day_cube(facts), aggregate.pincode_profile(facts))
    for module, name in ((segment, "cluster_pincodes"), (segment, "cluster_regions"), (learn, "train_demand"), (learn, "train_surge"), (learn, "feature_importance")):
        monkeypatch.setattr(module, name, refuse)
    assert list(reports.clustering_report(r, sections=["underserved"])) == ["underserved"]
    assert list(reports.ml_report(r, sections=["district_risk"])) == ["district_risk"]
