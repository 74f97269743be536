"""K-means, its seeding and silhouettes against plain versions."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from tallyfield.operators import kmeans
from tallyfield.operators import segment as sg


def table(spark, x, parts=3):
    return spark.createDataFrame([(f"p{i}", [float(v) for v in row]) for i, row in enumerate(x)], "id string, features array<double>").repartition(parts)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(c, 1.0, (40, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 7, 0), (3, 3, 9))])


def plain(x, centres):
    """Lloyd's iterations, cluster by cluster."""
    while True:
        near = np.array([[((p - c) ** 2).sum() for c in centres] for p in x]).argmin(1)
        new = np.array([x[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
        if np.abs(new - centres).max() < 1e-9:
            return new, sum(((p - new[j]) ** 2).sum() for p, j in zip(x, near))
        centres = new


def test_fits_of_all_ks_and_runs_against_plain_iterations(spark, cloud):
    points = table(spark, cloud).cache()
    starts = kmeans.seeds(points, 6, 4, 42)
    fits = kmeans.all_fits(points, [2, 4, 6], restarts=4)
    assert [(f.k, f.run) for f in fits] == [(k, r) for k in (2, 4, 6) for r in range(4)]
    for f in fits:
        centres, cost = plain(cloud, starts[f.run][: f.k])
        np.testing.assert_allclose(f.centres, centres, atol=1e-8)
        assert f.cost == pytest.approx(cost)
    best = kmeans.best_fits(points, [4], restarts=4)[4]
    theirs = KMeans(k=4, seed=1).fit(points.select(array_to_vector("features").alias("features"))).summary.trainingCost
    assert best.cost <= theirs * (1 + 1e-9)


def test_seeds_are_points_by_the_race(spark, cloud):
    starts = kmeans.seeds(table(spark, cloud), 4, 3, 7)
    again = kmeans.seeds(table(spark, cloud, 1), 4, 3, 7)
    for run, chosen in enumerate(starts):
        np.testing.assert_array_equal(chosen, again[run])
        for step in range(4):
            away = np.array([min((((p - c) ** 2).sum() for c in chosen[:step]), default=1.0) for p in cloud])
            time = [-np.log(kmeans.luck(7, run, step, f"p{i}")) / d if d else np.inf for i, d in enumerate(away)]
            np.testing.assert_array_equal(chosen[step], cloud[int(np.argmin(time))])


def test_silhouettes_against_all_pairs(spark, cloud):
    points = table(spark, cloud).cache()
    fits = list(kmeans.best_fits(points, [2, 3, 5], restarts=2).values())
    lonely = kmeans.Fit(2, 0, np.array([cloud[0] * 0 + 99, cloud.mean(0)]))
    far = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))

    def score(centres):
        label = ((cloud[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        out = []
        for i in range(len(cloud)):
            own = (label == label[i]) & (np.arange(len(cloud)) != i)
            others = [far[i][label == j].mean() for j in set(label.tolist()) - {label[i]}]
            out.append((min(others) - far[i][own].mean()) / max(min(others), far[i][own].mean()) if own.any() and others else 0.0)
        return np.mean(out)

    got = kmeans.silhouettes(points, fits)
    assert got == {f.k: pytest.approx(score(f.centres)) for f in fits}
    assert kmeans.silhouettes(points, [lonely]) == {2: 0.0}
    assert kmeans.silhouettes(points, fits, most=10) is None


def test_choose_k_beyond_the_bound_uses_squared_distances(spark, cloud, monkeypatch):
    points = table(spark, cloud).cache()
    exact = sg.choose_k(points, 6, restarts=2)
    monkeypatch.setattr(kmeans, "silhouettes", lambda *a: None)
    squared = sg.choose_k(points, 6, restarts=2)
    assert exact[0] == squared[0] == 4 and [r.k for r in squared[1].collect()] == [2, 3, 4, 5, 6]

def test_few_equal_and_no_points(spark):
    same = table(spark, [[1.0, 2.0]] * 5 + [[3.0, 4.0]])
    fit = kmeans.best_fits(same, [4], restarts=2)[4]
    assert len(fit.centres) == 2 and fit.cost == 0
    assert {(r.at, r["count"]) for r in same.select(kmeans.nearest("features", fit).alias("at")).groupBy("at").count().collect()} in ({(0, 5), (1, 1)}, {(1, 5), (0, 1)})
    none = same.limit(0)
    assert kmeans.best_fits(none, [3]) == {} and sg.choose_k(none)[0] == 1
    assert sg.choose_k(same.limit(2))[0] == 1


def test_an_emptied_cluster_stays(spark):
    points = table(spark, [[0.0], [1.0], [10.0]])
    fit = kmeans.Fit(2, 0, np.array([[0.0], [99.0]]))
    (size, _, cost), = kmeans._sums(points, [fit])
    assert size.tolist() == [3, 0] and cost == 101.0
