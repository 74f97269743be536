"""Holt's recurrence in stretches against the plain fold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import smoothing
from tallyfield.operators.smoothing import smoothed


def plain(values, alpha, beta):
    level, trend = values[0], values[1] - values[0] if len(values) > 1 else 0.0
    for y in values[1:]:
        new = alpha * y + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    return level, trend


@pytest.mark.parametrize(("alpha", "beta"), [(0.3, 0.1), (0.9, 0.9), (0.01, 0.02), (1.0, 1.0)])
def test_series_of_many_lengths(spark, monkeypatch, alpha, beta):
    monkeypatch.setattr(smoothing, "STRETCH", 16)
    rng = random.Random(1)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 40, "e": 33, "f": 1000, None: 17}
    rows = [(k, i, 100 + rng.random() * 1000 + i) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, y double").repartition(5)
    got = {r.k: r for r in smoothed(df, "i", "y", alpha, beta, ["k"]).collect()}
    for k, n in sizes.items():
        level, trend = plain([y for x, _, y in rows if x == k], alpha, beta)
        assert got[k].last == n - 1 and got[k].level == pytest.approx(level, rel=1e-9) and got[k].trend == pytest.approx(trend, rel=1e-9, abs=1e-7)


def test_ten_million_points(spark):
    df = spark.range(10_000_000).select("id", (F.pmod(F.col("id") * 7919, F.lit(1000)) + F.col("id") / 1000).alias("y"))
    r = smoothed(df, "id", "y", 0.05, 0.01).first()
    ids = np.arange(10_000_000)
    y = (ids * 7919) % 1000 + ids / 1000
    level, trend = plain(y[-60_000:].tolist(), 0.05, 0.01)  # what lies before weighs less than 1e-60
    assert r["last"] == 9_999_999 and r.level == pytest.approx(level, rel=1e-9) and r.trend == pytest.approx(trend, rel=1e-9)


def test_days_over_several_years_and_a_first_stretch_of_one_day(spark):
    df = spark.sql("SELECT explode(sequence(date'2020-12-31', date'2024-03-01')) AS date").selectExpr("date", "cast(pmod(hash(date), 900) as bigint) AS value")
    rows = df.orderBy("date").collect()
    level, trend = plain([float(r.value) for r in rows], 0.3, 0.1)
    r = smoothed(df.repartition(4), "date", "value", 0.3, 0.1).first()
    assert (r["last"], r.level, r.trend) == (rows[-1].date, pytest.approx(level, rel=1e-9), pytest.approx(trend, rel=1e-9))


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "i int, y double")
    assert [tuple(r) for r in smoothed(df, "i", "y", 0.3, 0.1).collect()] == [(3, None, None)]
    assert smoothed(df.limit(0), "i", "y", 0.3, 0.1).count() == 0 and smoothed(df.limit(0), "i", "y", 0.3, 0.1, []).columns == ["last", "level", "trend"]
    one = smoothed(df.where("i = 1"), "i", "y", 0.3, 0.1).first()
    assert (one["last"], one.level, one.trend) == (1, 1.0, 0.0) and not math.isnan(one.level)
