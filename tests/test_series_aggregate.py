import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import aggregate as g
from tallyfield.operators import joins as j
from tallyfield.operators import learn as m
from tallyfield.operators import select as e
from tallyfield.operators import series as s
from tallyfield.spec import DEFAULT as D
from tests.conftest import series

VALUES = [3, 8, 1, 9, 4, 4, 7, 12, 2, 5]


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None) == bool(pd.isna(b))
        if a is not None:
            assert a == pytest.approx(b)


def test_windows_match_pandas(spark):
    v, d = pd.Series(VALUES), series(spark, VALUES)
    same(column(s.rolling_mean(d, 7), "mean_7"), v.rolling(7, min_periods=1).mean())
    same(column(s.rolling_mean_strict(d, 3), "mean_3"), v.rolling(3).mean())
    same(column(s.rolling_std(d, 7), "std_7"), v.rolling(7, min_periods=1).std())
    for w in (4, 7):
        same(column(s.centered_mean(d, w), "trend"), v.rolling(w, center=True, min_periods=1).mean())
    same(column(s.lag_features(d, (1, 7)), "lag_7"), v.shift(7))
    same(column(s.cumulative_sum(d), "cumulative"), v.cumsum())
    same(column(s.zscore(d), "z_score"), (v - v.mean()) / v.std())


def test_run_ids_start_at_one(spark):
    flags = [True, True, False, False, True]
    d = series(spark, [1, 1, 0, 0, 1]).withColumn("f", F.col("value") == 1)
    assert column(s.run_ids(d, "f"), "run_id") == [1, 1, 2, 2, 3] and flags[0]


def test_one_row_and_constant_series(spark):
    one, flat = series(spark, [5]), series(spark, [5, 5, 5])
    assert s.zscore(one).first().z_score is None
    assert column(s.zscore(flat), "z_score") == [None] * 3
    assert s.minmax_scale(flat, "value", "x").first().x is None


@pytest.mark.parametrize("n", [1, 3, 4, 5, 7, 8, 100])
def test_tercile_matches_qcut(spark, n):
    df = spark.createDataFrame([(i % 3, f"d{i:03d}") for i in range(n)], "v bigint, k string")
    got = m.tercile(df, "v", ["k"], "c").orderBy("v", "k").collect()
    labels = [m.RISK_LABELS.index(r.c) for r in got]
    if n == 1:
        assert labels == [0]
    else:
        assert labels == list(pd.qcut(pd.Series(range(1, n + 1)), 3, labels=False))


def test_resample_fills_gaps_and_labels_period_end(spark, facts):
    weeks = g.resample_weekly(facts).orderBy("date").collect()
    assert weeks[0].date == dt.date(2025, 1, 12) and weeks[0].value == 31
    assert len(weeks) == 8 and sum(r.value for r in weeks) == 48 and weeks[1].value == 0
    months = [(r.date, r.value) for r in g.resample_monthly(facts).orderBy("date").collect()]
    assert months == [(dt.date(2025, 1, 31), 31), (dt.date(2025, 2, 28), 0), (dt.date(2025, 3, 31), 17)]
    assert g.monthly_total(facts).count() == 2


def test_totals_are_conserved(spark, facts):
    whole = facts.agg(F.sum(D.total)).first()[0]
    for df, c in (
        (g.daily_total(facts), "value"), (g.monthly_total(facts), "value"), (g.state_total(facts), D.total),
        (g.part_totals(facts), "value"), (e.top_with_others(facts, n=1), D.total), (g.day_cube(facts), D.total),
    ):
        assert df.agg(F.sum(c)).first()[0] == whole


def test_null_pincodes_drop_out(spark, facts):
    assert g.pincode_total(facts).agg(F.sum(D.total)).first()[0] == 41


def test_profiles_from_rollups_equal_profiles_from_facts(spark, facts):
    cube, pins = g.day_cube(facts), g.pincode_profile(facts)
    for build in (
        lambda d, p: g.geo_profile(d, pincodes=p),
        lambda d, p: g.region_features(d, pincodes=p),
        lambda d, p: g.region_features(d, level="state", pincodes=p),
        lambda d, p: g.district_volatility(d, pincodes=p),
    ):
        a, b = build(facts, None), build(cube, pins)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def test_ties_take_the_first_key(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1), ("d", 1)], "k string, v bigint")
    r = g.argmax_argmin(df, "v", "k").first()
    assert (r.max_key, r.min_key) == ("a", "c")
    assert [x.k for x in e.top_k(df, "v", ["k"], 3).collect()] == ["a", "b", "c"]


def test_weekday_total_keeps_absent_days(spark, facts):
    got = g.weekday_total(facts).orderBy("day_of_week").collect()
    assert [r.value for r in got] == [15, 10, None, None, None, 6, 17]
    filled = g.weekday_total(facts, fill=0).orderBy("day_of_week").collect()
    assert [r.above_average for r in filled] == [True, True, False, False, False, False, True]


def test_pivot_state_month(spark, facts):
    got = g.pivot_state_month(facts).collect()
    assert [(r.state, r.January, r.February, r.March, r.row_total) for r in got] == [
        ("Assam", 25, None, None, 25), ("Bihar", 6, None, 17, 23)
    ]


def test_rollup_has_subtotals(spark, facts):
    got = {(r.state, r.district): (r[D.total], r.depth) for r in g.hierarchy_rollup(facts).collect()}
    assert got[(None, None)] == (48, 0) and got[("Assam", None)] == (25, 1) and got[("Assam", "South")] == (5, 2)
    drilled = g.hierarchy_rollup(facts, state="Bihar").where("depth = 3").collect()
    assert {r.pincode for r in drilled} == {"220001", "220002"}


def test_top_with_others_only_when_positive(spark, facts):
    assert {r.state for r in e.top_with_others(facts, n=5).collect()} == {"Assam", "Bihar"}
    got = {r.state: r.pct for r in e.top_with_others(facts, n=1).collect()}
    assert got["Others"] == pytest.approx(23 / 48 * 100)


def test_neighbors_exclude_the_day_itself(spark):
    d = series(spark, VALUES)
    anchors = spark.createDataFrame([(dt.date(2025, 1, 8),)], "date date")
    got = j.interval_neighbors(d, anchors).orderBy("offset").collect()
    assert [(r.offset, r.value) for r in got] == [(-2, 3), (-1, 8), (1, 9), (2, 4), (3, 4)]


def test_gini_and_shares(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "k string, v bigint")
    assert g.gini(df, "v").first().gini == pytest.approx(1 / 6)
    assert g.top_share(df, "v", (1, 3)).first().top_1_share == 50.0


def test_pareto_ends_at_hundred(spark):
    df = spark.createDataFrame([("a", 70), ("b", 20), ("c", 10)], "k string, v bigint")
    got = s.pareto(df, "v", "k").orderBy("position").collect()
    assert got[-1].cumulative_pct == 100.0 and {r.reached_at for r in got} == {2}


def test_empty_selection_means_all_states(spark, facts):
    assert e.filter_states(facts, []).count() == 6 and e.filter_states(facts, ["Assam"]).count() == 3


def test_missing_keys_are_no_group(spark, facts):
    from tallyfield.operators import aggregate as g

    holes = facts.unionByName(facts.limit(2).selectExpr(
        "CAST(NULL AS DATE) AS date", "CAST(NULL AS STRING) AS state", "CAST(NULL AS STRING) AS district",
        *[c for c in facts.columns if c not in ("date", "state", "district")],
    ))
    for f in (g.monthly_total, g.weekly_total, g.state_total, g.district_total, g.monthly_part_totals, g.weekday_mean, g.month_name_total, g.quarter_total, g.state_part_totals):
        assert sorted(map(str, f(holes).collect())) == sorted(map(str, f(facts).collect())), f.__name__


def test_nan_is_missing_in_quantiles(spark):
    from tallyfield.operators.quantile import bucket
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.5,), (float("nan"),)], "value double")
    assert [r.b is None for r in df.select(bucket(F.col("value")).alias("b")).collect()] == [False, True]


def test_day_cube_holds_large_counts(spark, facts):
    from tallyfield.spec import DEFAULT as D
    from pyspark.sql import functions as F

    large = facts.withColumn(D.total, F.lit(4_000_000_000).cast("bigint"))
    assert g.day_cube(large).agg(F.sum("squares")).first()[0] == 16 * 10**18 * facts.count()
    row = g.district_volatility(large).where("daily_std IS NOT NULL").first()
    assert row is None or row.daily_std == 0.0


def test_demand_features_ignore_rows_without_a_date(spark):
    from tallyfield.operators import learn
    from tallyfield.spec import DEFAULT as D
    from pyspark.sql import functions as F

    days = spark.range(40).select(F.date_add(F.lit("2025-01-01").cast("date"), F.col("id").cast("int")).alias(D.date), F.col("id").alias(D.total))
    holes = days.unionByName(spark.range(1).select(F.lit(None).cast("date").alias(D.date), F.lit(9).cast("bigint").alias(D.total)))
    assert learn.demand_features(holes).collect() == learn.demand_features(days).collect()


def test_day_sets_count_days_and_pincodes_as_distinct_counts_do(spark):
    rng = random.Random(5)
    days = ["2023-12-31", "2024-12-31", "2025-12-31", "2024-02-29", "2024-01-01", "2024-03-04", "2024-03-05", None]
    rows = [(rng.choice(days), rng.choice("AB"), rng.choice(["X", "Y"]), rng.choice(["110001", "110002", None]), rng.randrange(9), 1, 2) for _ in range(300)]
    df = spark.createDataFrame(rows, "d string, state string, district string, pincode string, a bigint, b bigint, c bigint").selectExpr(
        "to_date(d) AS date", "state", "district", "pincode", "a AS age_0_5", "b AS age_5_17", "c AS age_18_greater", "a + b + c AS total_enrollments",
    )
    for keys in (["state"], ["state", "district"]):
        sets = g.day_sets(df, ["state", "district"])
        got = g.from_day_sets(sets, keys, ["total_enrollments", "records", "squares"]).collect()
        want = df.groupBy(*keys).agg(
            F.sum("total_enrollments").alias("total_enrollments"), F.count("*").alias("records"),
            F.sum(F.col("total_enrollments") * F.col("total_enrollments")).alias("squares"),
            F.count_distinct("date").alias("active_days"), F.count_distinct("pincode").alias("unique_pincodes"),
        ).collect()
        assert sorted(tuple(int(x) if isinstance(x, Decimal) else x for x in r) for r in got) == sorted(tuple(r) for r in want)
    every = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2024-12-31')) AS date").selectExpr(
        "date", "'S' AS state", "'D' AS district", "'1' AS pincode", "1L AS age_0_5", "0L AS age_5_17", "0L AS age_18_greater", "1L AS total_enrollments")
    assert g.from_day_sets(g.day_sets(every, ["state"]), ["state"], []).first().active_days == 731
