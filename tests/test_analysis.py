import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import anomaly as an
from tallyfield.operators import forecast as fc
from tallyfield.operators import joins as j
from tallyfield.operators import kpi as k
from tallyfield.operators import learn as m
from tallyfield.operators import segment as sg
from tests.conftest import series


def test_zscore_and_iqr_flag_the_spike(spark):
    d = series(spark, [10] * 15 + [11] * 15 + [500])
    z = an.detect_zscore(d).collect()
    assert [(r.value, r.anomaly_type) for r in z] == [(500, "High")]
    assert an.detect_iqr(d).count() == 1
    assert an.zscore_daily(d).where("anomaly_type = 'Normal'").count() == 30


def test_runs_need_their_length(spark):
    d = series(spark, [10, 10, 10, 10, 10, 40, 80, 10, 10])
    assert an.detect_runs(d, 7, 1.5, 2).select("duration").first().duration == 2
    assert an.detect_runs(d, 7, 1.5, 3).count() == 0


def test_decomposition_adds_up(spark):
    d = series(spark, [(i * 7) % 13 + i for i in range(40)])
    got = an.seasonal_decompose(d).selectExpr("abs(trend + seasonal + residual - original) AS e")
    assert got.agg(F.max("e")).first()[0] < 1e-9


def test_holiday_impact(spark):
    d = series(spark, [100, 100, 100, 50, 100, 100, 100], "2025-10-17")
    r = an.holiday_impact(d, j.holiday_calendar(spark)).collect()
    assert len(r) == 1
    assert (r[0].date, r[0].holiday, r[0].enrollments, r[0].impact_pct, r[0].recovery_days) == (
        dt.date(2025, 10, 20), "Dussehra", 50, -50.0, 1
    )
    alone = an.holiday_impact(series(spark, [50, 10], "2025-12-25"), j.holiday_calendar(spark)).first()
    assert alone.avg_before is None and alone.recovery_days == 2


def test_control_limits_do_not_go_below_zero(spark):
    r = an.control_limits(series(spark, [1, 1, 1, 1, 30])).first()
    assert r.lcl == 0.0 and r.lwl == 0.0 and r.ucl > r.uwl > r["mean"]


def test_geo_scores_from_published_figures(spark):
    """593,753 over 88 days is 6,747.19 a day, over 906 pincodes 655.36 each."""
    days = spark.range(88).selectExpr("date_add(date'2025-01-01', cast(id as int)) AS date", "id")
    df = days.selectExpr(
        "date", "'Bihar' AS state", "'X' AS district", "cast(id as string) AS pincode",
        "CASE WHEN id = 0 THEN 593753 - 87 ELSE 1 END AS total_enrollments",
    )
    pins = spark.range(906).selectExpr("'Bihar' AS state", "cast(id as string) AS pincode")
    r = an.geo_scores(df, pincodes=pins).first()
    assert r.enrollments_per_day == pytest.approx(6747.193181818182)
    assert r.enrollments_per_pincode == pytest.approx(655.3565121412804)


def holt(values, periods, a, b):
    level, trend = float(values[0]), float(values[1] - values[0]) if len(values) > 1 else 0.0
    for v in values[1:]:
        new = a * v + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        level = new
    return [max(0.0, level + i * trend) for i in range(1, periods + 1)]


@pytest.mark.parametrize("values", [[5], [5, 9], [10, 4, 30, 22, 8, 3, 1]])
def test_holt_matches_the_recurrence(spark, values):
    got = fc.holt(series(spark, values), 5).orderBy("step").collect()
    assert [r.forecast for r in got] == pytest.approx(holt(values, 5, 0.3, 0.1))
    assert got[0].lower_bound == pytest.approx(got[0].forecast * 0.7)


def test_moving_average_trend_divides_by_the_window(spark):
    got = fc.moving_average(series(spark, [0, 7, 14, 21, 28, 35, 42, 49]), 2).orderBy("step").collect()
    assert [r.forecast for r in got] == pytest.approx([28 + 3, 28 + 6])
    short = fc.moving_average(series(spark, [1, 2]), 1).first()
    assert short.forecast is None and short.date == dt.date(2025, 1, 8)


def seasonal(values, dow_last, periods, p=7):
    v = np.array(values, float)
    n = len(v)
    trend = np.array([v[max(0, i - p // 2): i + (p - 1) // 2 + 1].mean() for i in range(n)])
    off = v - trend
    f = np.array([off[i::p].mean() for i in range(p)])
    f -= f.mean()
    slope = (trend[-1] - trend[-p]) / p if n > p else 0
    return [max(0, trend[-1] + i * slope + f[(dow_last + i) % p]) for i in range(1, periods + 1)], off.std()


@pytest.mark.parametrize("start", ["2025-01-06", "2025-01-09"])
def test_seasonal_follows_position_phase(spark, start):
    values = [(i * 5) % 11 * 10 + i for i in range(24)]
    last = dt.date.fromisoformat(start) + dt.timedelta(days=23)
    want, sigma = seasonal(values, last.weekday(), 10)
    got = fc.seasonal(series(spark, values, start), 10).orderBy("step").collect()
    assert [r.forecast for r in got] == pytest.approx(want)
    assert got[0].upper_bound - got[0].forecast == pytest.approx(1.96 * sigma)


def test_seasonal_runs_many_series_at_once(spark):
    a = series(spark, [(i * 5) % 11 * 10 + i for i in range(24)]).withColumn("state", F.lit("a"))
    b = series(spark, [(i * 3) % 7 * 9 + 2 * i for i in range(30)]).withColumn("state", F.lit("b"))
    both = fc.seasonal(a.unionByName(b), 5, by=["state"])
    for name, one in (("a", a), ("b", b)):
        alone = [r.forecast for r in fc.seasonal(one, 5).orderBy("step").collect()]
        got = [r.forecast for r in both.where(F.col("state") == name).orderBy("step").collect()]
        assert got == pytest.approx(alone)


def test_weekday_phase_equals_position_phase_from_a_monday(spark):
    d = series(spark, [(i * 5) % 11 * 10 + i for i in range(28)])
    one = [r.forecast for r in fc.seasonal(d, 7).orderBy("step").collect()]
    two = [r.forecast for r in fc.seasonal(d, 7, phase="weekday").orderBy("step").collect()]
    assert one == pytest.approx(two)


def test_milestones(spark):
    got = fc.milestones(series(spark, [10] * 40), (400, 405, 1000)).orderBy("milestone").collect()
    last = dt.date(2025, 1, 6) + dt.timedelta(days=39)
    assert [(r.status, r.days_from_now) for r in got] == [("Achieved", None), ("Projected", 1), ("Projected", 60)]
    assert got[2].projected_date == last + dt.timedelta(days=60)


def test_seasonality_matches_published_index(spark):
    totals = {3: 16582, 4: 257438, 5: 183616, 6: 215734, 7: 616868, 9: 1475824, 10: 779570, 11: 1052536, 12: 733414}
    df = spark.createDataFrame([(dt.date(2025, mth, 1), v) for mth, v in totals.items()], "date date, total_enrollments bigint")
    got = {r.month: (r.month_name, r.seasonality_index, r.recommendation) for r in k.seasonality_index(df).collect()}
    assert got[3] == ("Mar", 2.8, "Reduce Staff") and got[7] == ("Jul", 104.13, "Normal")
    assert got[9] == ("Sep", 249.13, "Add Staff") and len(got) == 9
    r = k.seasonality_extremes(k.seasonality_index(df)).first()
    assert (r.peak_month, r.low_month) == (9, 3)


def test_capacity_bands_are_right_closed(spark):
    rows = [(f"d{i}", dt.date(2025, 1, 1), v) for i, v in enumerate([0, 250, 251, 400, 500, 501])]
    df = spark.createDataFrame(rows, "district string, date date, total_enrollments bigint")
    got = [r.capacity_status for r in k.capacity_utilization(df).orderBy("district").collect()]
    assert got == [None, "Under-utilized", "Optimal", "Optimal", "Near Capacity", "Over Capacity"]


def kpis(spark, **values):
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])


def test_every_recommendation_rule(spark):
    low = k.recommendations(kpis(
        spark, weekend_efficiency=64.5, top_5_states_share=61.0, coefficient_of_variation=127.2, pct_age_0_5=12.25
    )).collect()
    assert [r.category for r in low] == ["Operations", "Geographic", "Planning", "Outreach", "Technology", "Monitoring"]
    assert "only 64% of" in low[0].description and "CV=127%" in low[2].description and "12.2%" in low[3].description
    calm = k.recommendations(kpis(
        spark, weekend_efficiency=70.0, top_5_states_share=60.0, coefficient_of_variation=30.0, pct_age_0_5=25.0
    )).collect()
    assert [r.category for r in calm] == ["Technology", "Monitoring"]


def test_kpis_of_a_small_table(spark, facts):
    r = k.merged_kpis(facts).first()
    assert (r.total_enrollments, r.total_records, r.total_days, r.total_districts, r.total_pincodes) == (48, 6, 4, 2, 4)
    assert r.top_state == "Assam" and r.top_district == "North" and r.best_month == 1
    assert r.weekday_avg == 12.5 and r.weekend_avg == 11.5 and r.weekend_efficiency == pytest.approx(92.0)
    assert r.enrollments_per_state == 24.0 and r.pct_age_0_5 == pytest.approx(17 / 48 * 100)


def test_cluster_names_take_the_first_rule(spark):
    rows = [(0, 100.0, 50.0, 10.0), (1, 1.0, 10.0, 90.0), (2, 50.0, 41.0, 60.0), (3, 51.0, 10.0, 60.0), (4, 52.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "cluster int, avg_daily double, avg_pct_children double, avg_pct_adults double")
    got = {r.cluster: r.cluster_name for r in sg.name_clusters(df).collect()}
    assert got == {0: "High Volume", 1: "Low Volume", 2: "Child-Focused", 3: "Adult-Dominated", 4: "Balanced"}


def test_kmeans_separates_obvious_groups(spark):
    rows = [(f"{x}-{dx}", float(x + dx)) for x in (0, 100, 200) for dx in range(5)]
    points = sg.scaled_points(spark.createDataFrame(rows, "name string, x double"), ["x"], ["name"])
    best, scores = sg.choose_k(points, 5, restarts=3)
    assert best == 3 and scores.count() == 4
    fit = sg.kmeans.best_fits(points, [3], restarts=3)[3]
    sizes = points.groupBy(sg.kmeans.nearest("features", fit).alias("at")).count().collect()
    assert [r["count"] for r in sizes] == [5, 5, 5]


def test_classification_report(spark):
    pairs = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)]
    got = {r["class"]: r for r in m.classification_metrics(spark.createDataFrame(pairs, "y int, p int"), "y", "p").collect()}
    assert got["Surge"].precision == pytest.approx(0.6) and got["Surge"].recall == pytest.approx(0.75)
    assert got["accuracy"].f1 == pytest.approx(0.75) and got["macro avg"].support == 12
    assert got["weighted avg"].recall == pytest.approx((0.75 * 8 + 0.75 * 4) / 12)
    none = m.classification_metrics(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p")
    assert none.where("class = 'Surge'").first().f1 == 0.0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    r = m.regression_metrics(df, "y", "p").first()
    assert r.mae == pytest.approx(2 / 3) and r.r2 == pytest.approx(1 - 2 / 8)


def year(spark):
    v = [100 + 40 * math.sin(i) + (300 if i % 17 == 0 else 0) for i in range(150)]
    return series(spark, [int(x) for x in v], "2024-09-01").selectExpr(
        "date", "'S' AS state", "'D' AS district", "'110001' AS pincode", "value AS total_enrollments",
        "cast(value / 2 as bigint) AS age_0_5", "value - cast(value / 2 as bigint) AS age_5_17", "0L AS age_18_greater",
    )


def test_splits(spark):
    f = m.demand_features(year(spark))
    assert f.count() == 150 - 14
    got = m.chrono_split(f).groupBy("is_train").agg(F.count("*").alias("n"), F.max("date").alias("d")).collect()
    sizes = {r.is_train: r.n for r in got}
    assert sizes == {True: 108, False: 28}
    split = m.random_split(f)
    assert split.where("not is_train").count() == math.ceil(136 * 0.2)
    again = m.random_split(f.repartition(7))
    assert set(split.where("is_train").select("date").collect()) == set(again.where("is_train").select("date").collect())


def test_models_train_and_report(spark):
    _, importance, metrics = m.train_demand(year(spark), trees=10)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert metrics.first().rows == 28
    _, report, scored = m.train_surge(year(spark), trees=10)
    assert report.count() == 5 and scored.where("prediction IS NULL").count() == 0
    ranked = m.feature_importance(year(spark), trees=5)
    assert ranked.count() == 5 and ranked.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_risk_thirds(spark, facts):
    got = m.district_risk(facts)
    assert got.count() == 3
    assert {r.districts for r in m.risk_summary(got).collect()} == {1}
    scores = [r.risk_score for r in got.collect()]
    assert scores == sorted(scores, reverse=True)
