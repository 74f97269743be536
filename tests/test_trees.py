"""Fitted trees as tables: SQL walks them, too, and what features are worth."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import learn as m
from tallyfield.operators import trees
from tests.test_analysis import year

WALK = """
WITH RECURSIVE walk AS (
    SELECT date, tree, weight, 0 AS node FROM facts, (SELECT DISTINCT tree, weight FROM nodes)
    UNION ALL
    SELECT w.date, w.tree, w.weight, CASE WHEN list_extract(x, CAST(feature AS BIGINT) + 1) <= threshold THEN n."left" ELSE n."right" END
    FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN facts f ON f.date = w.date WHERE n."left" >= 0
)
SELECT w.date, sum(w.weight * n.value) AS score, sum(w.weight) AS weight, count(*) AS n_trees
FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n."left" < 0 GROUP BY w.date
"""


def walked_by_sql(model, rows, columns):
    con = duckdb.connect()
    nodes = trees.tree_table(model, rows.sparkSession).toPandas()
    facts = rows.select("date", F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).toPandas()
    con.register("nodes", nodes)
    con.register("facts", facts)
    return {d.date() if hasattr(d, "date") else d: (s, w, n) for d, s, w, n in con.sql(WALK).fetchall()}


def test_demand_forest_walked_by_sql(spark):
    model, _, metrics = m.train_demand(year(spark), trees=7, depth=6)
    rows = m.chrono_split(m.demand_features(year(spark))).where("not is_train").cache()
    told = walked_by_sql(model, rows, m.DEMAND_FEATURES)
    ours = {r.date: r for r in m.walked(model, rows, m.DEMAND_FEATURES, ["date"]).collect()}
    assert set(told) == set(ours) and all(n == 7 == ours[d].n_trees and s / w == pytest.approx(ours[d].walked) for d, (s, w, n) in told.items())
    total = {r.date: r.total_enrollments for r in rows.collect()}
    off = np.array([total[d] - s / w for d, (s, w, _) in told.items()])
    got, y = metrics.first(), np.array([total[d] for d in told])
    assert got.mae == pytest.approx(np.abs(off).mean()) and got.r2 == pytest.approx(1 - (off**2).sum() / ((y - y.mean()) ** 2).sum())


def test_surge_forest_walked_by_sql(spark):
    model, report, scored = m.train_surge(year(spark), trees=9)
    rows = m.random_split(m.surge_features(year(spark))).where("not is_train").cache()
    told = walked_by_sql(model, rows, m.SURGE_FEATURES)
    guess = {d: int(s / w > 0.5) for d, (s, w, _) in told.items()}
    pairs = [(r.is_surge, guess[r.date], r.prediction) for r in scored.collect()]
    assert len(pairs) == len(told) and all(g == p for _, g, p in pairs)
    assert report.where("class = 'accuracy'").first().f1 == pytest.approx(np.mean([y == g for y, g, _ in pairs]))
    with pytest.raises(ValueError):
        trees.tree_table(type("Three", (), {"write": model.write, "treeWeights": [], "trees": [], "numClasses": 3})(), spark)


def test_boosted_trees_and_what_features_are_worth(spark):
    model, rows, columns = m.fit_importance(year(spark), trees=12)
    told = walked_by_sql(model, rows, columns)
    scored = {r.date: r.prediction for r in model.transform(m._vectors(rows, columns)).collect()}
    assert all(s == pytest.approx(scored[d]) for d, (s, _, _) in told.items())
    days = rows.toPandas().sort_values("date").reset_index(drop=True)
    versions = m.permuted(rows, columns, repeats=2).toPandas()
    assert len(versions) == len(columns) * 2 * len(days)
    for (feature, _), part in versions.groupby(["feature", "repeat"]):
        part = part.sort_values("date").reset_index(drop=True)
        assert sorted(part[feature]) == sorted(days[feature])
        assert all((part[c] == days[c]).all() for c in days.columns if c != feature)
    y = days.total_enrollments.to_numpy(float)
    r2 = lambda p: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    whole = r2(np.array([scored[d] for d in days.date]))
    lost = m.permutation_importance(model, rows, columns, "total_enrollments", repeats=2).collect()
    assert {r.feature for r in lost} == set(columns)
    for r in lost:
        each = []
        for k in range(2):
            part = versions[(versions.feature == r.feature) & (versions.repeat == k)].sort_values("date")
            frame = rows.sparkSession.createDataFrame(part[["date", *columns]])
            p = {x.date: x.prediction for x in model.transform(m._vectors(frame, columns)).collect()}
            each.append(whole - r2(np.array([p[d] for d in days.date])))
        assert r.r2_loss == pytest.approx(np.mean(each)) and r.r2_deviation == pytest.approx(np.std(each))


def test_bins_follow_the_distinct_values(spark):
    df = spark.range(3000).selectExpr("id AS a", "id % 5 AS b", "id % 90 AS c")
    assert m.bins_for(df, ["b"]) == 32 and m.bins_for(df, ["a", "b"]) == m.MAX_BINS and 92 <= m.bins_for(df, ["c", "b"]) <= 130
    assert m.bins_for(df.limit(0), ["a"]) == 32
