"""Distributed order statistics against numpy, skewed data included."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyfield.operators.quantile import average_rank_percent, exact_quantiles

PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**6, 10**9), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = exact_quantiles(df, ["v"], PROBS).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12, abs=1e-9)


def test_quantiles_with_one_value_holding_a_third(spark):
    rng = np.random.default_rng(3)
    values = [7] * 4000 + [int(x) for x in rng.integers(0, 10**6, 8000)]
    groups = ["hot"] * 9000 + ["cold"] * 3000
    df = spark.createDataFrame(pd.DataFrame({"g": groups, "v": values}))
    got = {r.g: r for r in exact_quantiles(df, ["v"], PROBS, ["g"]).collect()}
    for g, part in (("hot", values[:9000]), ("cold", values[9000:])):
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.percentile(part, p * 100))


def test_quantiles_of_small_fractions_keep_order(spark):
    values = [0.001, 0.002, 0.5, -0.25, 0.0, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, ["v"], PROBS).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.percentile(values, p * 100))


def test_nulls_do_not_count(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v bigint")
    assert exact_quantiles(df, ["v"], {"m": 0.5}).first().m == 2


def test_average_rank_matches_pandas(spark):
    values = [5, 1, 5, 5, 2, 9, 2, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v bigint")
    got = [r.p for r in average_rank_percent(df, "v", "p").orderBy("i").collect()]
    want = pd.Series(values).rank(pct=True) * 100
    assert got[:-1] == pytest.approx(list(want[:-1]))
    assert got[-1] is None


def test_crowded_buckets_are_cut_evenly(spark):
    """Values of one magnitude, small fractions as well as times, spread over many parts."""
    from pyspark.sql import functions as F

    from tallyfield.operators import quantile

    for base in (0.0, 1.7e9):
        step = 1e-8 if base == 0.0 else 1.0
        df = spark.range(60_000).select((F.col("id") * step + base).alias("v"))
        hist = quantile.histogram(df, ["v"])
        crowds = hist.groupBy("bucket").agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
        parts = hist.join(crowds, "bucket").groupBy(
            "bucket", quantile.part(F.col("value"), F.col("a"), F.col("b"), F.col("n")).alias("part")
        ).count()
        assert parts.agg(F.max("count")).first()[0] <= 2 * quantile.CROWD
        got = quantile.exact_quantiles(df, ["v"], {"p50": 0.5}).first().p50
        assert abs(got - (29_999.5 * step + base)) <= 1e-9 * max(1.0, base)


def test_buckets_keep_the_order_of_any_magnitude(spark):
    from pyspark.sql import functions as F

    from tallyfield.operators.quantile import bucket

    values = sorted([0.0, 5e-324, 1e-300, 0.001, 0.0015, 0.5, 1.0, 1.5, 2.0, 3e9, 1e300, float("inf")])
    values = [-v for v in values[:0:-1]] + values
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", bucket(F.col("v")).alias("b")).collect()
    found = [r.b for r in sorted(rows, key=lambda r: r.v)]
    assert found == sorted(found) and None not in found
