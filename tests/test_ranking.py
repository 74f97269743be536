"""Positions and running sums by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import aggregate as g
from tallyfield.operators import clean as c
from tallyfield.operators import series as s
from tallyfield.operators.ranking import ranked


def test_positions_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "Ä", "b", "", None, "z" * 40]), i, rng.choice([1, 5, None, -2, 100])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v bigint").repartition(7)
    got = ranked(df, [F.desc_nulls_last("k"), F.asc("i")], "at", {"upto": "v"}, {"every": "v"}).collect()
    want = sorted(rows, key=lambda r: r[1])
    want.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode()), reverse=True)
    run = 0
    for at, (k, i, v) in enumerate(want, 1):
        run += v or 0
        r = next(x for x in got if x.i == i) if at % 500 == 0 else None
        if r:
            assert (r.at, r.upto, r.k) == (at, run, k)
    assert sorted(r.at for r in got) == list(range(1, 3001)) and {r.every for r in got} == {sum(v or 0 for *_, v in rows)}
    assert {r.i: r.at for r in got} == {i: at for at, (_, i, _) in enumerate(want, 1)}
    assert ranked(df.limit(0), ["k"], running={"upto": "v"}, whole={"every": "v"}).count() == 0


def test_labels_are_numbered_in_no_single_task(spark):
    df = spark.range(30_000).selectExpr("concat('p', id % 9000) AS pincode", "id")
    made = c.label_encode(df, "pincode")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    codes = {r.pincode: r.pincode_encoded for r in made.select("pincode", "pincode_encoded").distinct().collect()}
    assert codes == {p: k for k, p in enumerate(sorted(codes))} and len(codes) == 9000
    shares = s.pareto(df.groupBy("pincode").agg(F.sum("id").alias("v")), "v", "pincode")
    lines = shares._jdf.queryExecution().executedPlan().toString()
    assert "Window" in lines and "SinglePartition" not in lines.split("Subquery")[0]


def test_gini_and_top_shares_of_many_totals(spark):
    rng = random.Random(8)
    values = [rng.choice([1, 1, 2, 7, 7, 7, 50, 1000]) + (i % 3) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    up = sorted(values)
    n, total = len(up), sum(up)
    want = (2 * sum(i * v for i, v in enumerate(up, 1)) - (n + 1) * total) / (n * total)
    assert g.gini(df, "v").first().gini == pytest.approx(want)
    r = g.top_share(df, "v").first()
    assert r.top_10_share == pytest.approx(100 * sum(up[-10:]) / total) and r.top_1_share == pytest.approx(100 * up[-1] / total)
    assert g.gini(df.limit(0), "v").first().gini is None
