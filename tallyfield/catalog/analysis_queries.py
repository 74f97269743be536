"""Queries: series, joins, filters, anomalies, forecasts, learning, KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as g
from ..operators import anomaly as an
from ..operators import forecast as fc
from ..operators import joins as j
from ..operators import kpi as k
from ..operators import learn as m
from ..operators import profile as p
from ..operators import segment as sg
from ..operators import select as e
from ..operators import series as s
from ..operators.quantile import average_rank_percent
from ..sources import files, tables
from ..sources.scratch import pinned
from .common import A, Registry, daily, districts, fixed_holidays, lines, monthly, records, states

Q = Registry()
add = Q.add
PLACE = ("date", "state", "district", "pincode")


def state_days(spark, sf):
    return g.daily_total(lines(spark, sf, "date", "state"), A, by=["state"])


def event_days(spark, sf):
    return g.daily_total(tables.event_series(spark, sf), A, by=["state"])


# --- ordered series ----------------------------------------------------------

@add("zscore")
def _(spark, sf):
    return s.zscore(daily(spark, sf))


@add("rolling_mean")
def _(spark, sf):
    return s.rolling_mean(daily(spark, sf), 7)


@add("rolling_mean_weekly")
def _(spark, sf):
    return s.rolling_mean(g.weekly_total(lines(spark, sf), A), 4, order="week")


@add("rolling_mean_strict")
def _(spark, sf):
    out = daily(spark, sf)
    for w in (3, 7, 14):
        out = s.rolling_mean_strict(out, w)
    return out


@add("rolling_mean_strict_by_type")
def _(spark, sf):
    return s.rolling_mean_strict(event_days(spark, sf), 7, ["state"])


@add("rolling_std")
def _(spark, sf):
    return s.rolling_std(daily(spark, sf), 7)


@add("centered_mean")
def _(spark, sf):
    return s.centered_mean(daily(spark, sf), 7)


@add("centered_mean_even")
def _(spark, sf):
    return s.centered_mean(event_days(spark, sf), 4, ["state"])


@add("lag_features")
def _(spark, sf):
    return s.lag_features(daily(spark, sf))


@add("cumulative_sum")
def _(spark, sf):
    return s.cumulative_sum(daily(spark, sf))


@add("pct_change")
def _(spark, sf):
    return s.pct_change(monthly(spark, sf))


@add("growth_summary")
def _(spark, sf):
    return s.growth_summary(monthly(spark, sf))


@add("month_diff_waterfall")
def _(spark, sf):
    return s.month_waterfall(monthly(spark, sf))


@add("run_ids")
def _(spark, sf):
    mean = F.avg("value").over(s.whole())
    return s.run_ids(daily(spark, sf).withColumn("above", F.col("value") > mean), "above")


@add("percentile_rank_avg")
def _(spark, sf):
    return average_rank_percent(g.pincode_total(lines(spark, sf, "pincode"), A), "total", "percentile")


@add("rank_first_tercile")
def _(spark, sf):
    bands = districts(spark, sf).withColumn("score", F.floor(F.col("total") / 1000))
    return m.tercile(bands, "score", ["state", "district"], "category")


@add("cumulative_share")
def _(spark, sf):
    return s.pareto(states(spark, sf), "total", "state")


@add("threshold_crossing")
def _(spark, sf):
    return s.threshold_crossing(daily(spark, sf), (100_000, 500_000, 1_000_000, 5_000_000_000))


@add("minmax_scale")
def _(spark, sf):
    return s.minmax_scale(districts(spark, sf), "total", "scaled")


@add("max_scale")
def _(spark, sf):
    return s.max_scale(districts(spark, sf), "total", "scaled", 100.0)


@add("cap_at_quantile")
def _(spark, sf):
    return s.cap_at_quantile(districts(spark, sf), "total", 0.95, "capped")


@add("tail_mean")
def _(spark, sf):
    return s.tail_mean(daily(spark, sf))


# --- joins -------------------------------------------------------------------

@add("semi_top_states")
def _(spark, sf):
    return e.semi_top_states(records(spark, sf), A, 5)


@add("lookup_weekday_mean")
def _(spark, sf):
    return j.lookup_weekday_mean(daily(spark, sf))


@add("holiday_lookup")
def _(spark, sf):
    return j.holiday_lookup(daily(spark, sf), fixed_holidays(spark))


@add("holiday_anti")
def _(spark, sf):
    return j.holiday_anti(daily(spark, sf), fixed_holidays(spark))


@add("interval_neighbors")
def _(spark, sf):
    return j.interval_neighbors(daily(spark, sf), fixed_holidays(spark))


@add("scalar_broadcast")
def _(spark, sf):
    return j.with_scalars(districts(spark, sf), {
        "mean": F.avg("total"), "std": F.stddev_samp("total"), "q90": F.percentile("total", F.lit(0.9)),
    })


@add("cluster_name_lookup")
def _(spark, sf):
    placed = pinned(placed_districts(spark, sf), "placed")
    names = sg.name_clusters(sg.cluster_profiles(placed, A), A).select("cluster", "cluster_name")
    return j.name_lookup(placed.select("state", "district", "cluster"), names, "cluster")


@add("dimension_reindex")
def _(spark, sf):
    from ..functions.calendar import WEEKDAYS

    weekdays = g.total_by(
        lines(spark, sf),
        [F.date_format("date", "EEEE").alias("day_name")], "total", "value",
    )
    return j.reindex(weekdays, "day_name", WEEKDAYS)


# --- filters, top-k ----------------------------------------------------------

@add("filter_date_range")
def _(spark, sf):
    return e.filter_date_range(records(spark, sf), "1996-03-01", "1996-05-31", A)


@add("filter_states")
def _(spark, sf):
    return e.filter_states(records(spark, sf), ["NATION_2", "NATION_11"], A)


@add("filter_states_none")
def _(spark, sf):
    return g.state_total(e.filter_states(lines(spark, sf, "state"), [], A), A)


@add("filter_value_range")
def _(spark, sf):
    return e.filter_value_range(records(spark, sf), 45, 60, A)


@add("filter_drill_state")
def _(spark, sf):
    return e.filter_drill_state(records(spark, sf), "NATION_7", A)


@add("sort_recent_first")
def _(spark, sf):
    return e.sort_recent_first(records(spark, sf), A)


@add("top_states")
def _(spark, sf):
    return e.top_states(lines(spark, sf, "state"), A)


@add("top_districts")
def _(spark, sf):
    return e.top_districts(lines(spark, sf, "state", "district"), A, 20)


@add("bottom_districts")
def _(spark, sf):
    return e.bottom_districts(lines(spark, sf, "state", "district"), A)


@add("top_pincodes")
def _(spark, sf):
    return e.top_pincodes(lines(spark, sf, "pincode"), A)


@add("top_with_others")
def _(spark, sf):
    return e.top_with_others(lines(spark, sf, "state"), A, 8)


@add("top_bottom_pincodes")
def _(spark, sf):
    return an.detect_pincodes(lines(spark, sf, *PLACE), A, 20)


@add("filter_min_history")
def _(spark, sf):
    return e.filter_min_history(g.daily_total(lines(spark, sf, "date", "pincode"), A, by=["pincode"]), ["pincode"], 40)


@add("union_shards")
def _(spark, sf):
    rows = lines(spark, sf, "date", "state")
    old = rows.where(F.year("date") < 1999).select("state", "total", "date")
    new = rows.where(F.year("date") >= 1999).select("date", "part_a", "total", "state")
    return g.total_by(files.union_shards(new, old), ["state"], "total").join(
        files.union_shards(new, old).groupBy("state").agg(F.count("part_a").alias("with_part")), "state"
    )


@add("top_performers")
def _(spark, sf):
    scored = an.geo_scores(lines(spark, sf, *PLACE), A, threshold=1.0)
    cols = ["state", "total", "units_per_day"]
    high = e.top_k(scored.where("is_high_performer"), "units_per_day", ["state"], 10).select(*cols, F.lit("high").alias("side"))
    low = e.top_k(scored.where("is_low_performer"), "units_per_day", ["state"], 10, smallest=True).select(*cols, F.lit("low").alias("side"))
    return high.unionByName(low)


@add("top_high_risk")
def _(spark, sf):
    risk = m.district_risk(records(spark, sf), A).where(F.col("risk_category") == "High Risk")
    return e.top_k(risk, "risk_score", ["state", "district"], 15)


@add("distinct_sorted")
def _(spark, sf):
    return e.distinct_sorted(lines(spark, sf, "state"), "state")


@add("date_bounds")
def _(spark, sf):
    return e.date_bounds(lines(spark, sf), A)


# --- anomalies ---------------------------------------------------------------

@add("anomaly_zscore")
def _(spark, sf):
    return an.detect_zscore(daily(spark, sf))


@add("anomaly_zscore_daily")
def _(spark, sf):
    return an.zscore_daily(daily(spark, sf))


@add("anomaly_zscore_by_state")
def _(spark, sf):
    return an.detect_zscore(state_days(spark, sf), by=["state"])


@add("anomaly_iqr")
def _(spark, sf):
    return an.detect_iqr(daily(spark, sf))


@add("anomaly_iqr_daily")
def _(spark, sf):
    return an.iqr_daily(daily(spark, sf))


@add("anomaly_runs")
def _(spark, sf):
    return an.detect_runs(daily(spark, sf), 7, 1.5, 2)


@add("anomaly_runs_daily")
def _(spark, sf):
    return an.deviation_daily(daily(spark, sf))


@add("seasonal_decompose")
def _(spark, sf):
    return an.seasonal_decompose(daily(spark, sf))


@add("seasonal_decompose_30")
def _(spark, sf):
    return an.residual_anomalies(daily(spark, sf), 30)


@add("anomaly_geo")
def _(spark, sf):
    return an.detect_geographic(lines(spark, sf, *PLACE), A)


@add("anomaly_geo_scores")
def _(spark, sf):
    return an.geo_scores(lines(spark, sf, *PLACE), A, threshold=1.0)


@add("anomaly_geo_district")
def _(spark, sf):
    return an.geo_scores(tables.segment_lines(spark, sf, PLACE), A, "district", 1.0)


@add("anomaly_pincode")
def _(spark, sf):
    return an.pincode_scores(lines(spark, sf, *PLACE), A)


@add("holiday_impact")
def _(spark, sf):
    return an.holiday_impact(daily(spark, sf), fixed_holidays(spark), A)


@add("holiday_baseline")
def _(spark, sf):
    return an.holiday_baseline(daily(spark, sf), fixed_holidays(spark))


@add("holiday_mean_impact")
def _(spark, sf):
    return an.holiday_mean_impact(an.holiday_impact(daily(spark, sf), fixed_holidays(spark), A))


@add("control_limits")
def _(spark, sf):
    return an.control_limits(daily(spark, sf))


# --- forecasts ---------------------------------------------------------------

@add("forecast_ma")
def _(spark, sf):
    return fc.moving_average(daily(spark, sf))


@add("forecast_holt")
def _(spark, sf):
    return fc.holt(daily(spark, sf))


@add("forecast_holt_by_type")
def _(spark, sf):
    return fc.holt(event_days(spark, sf), 14, 0.5, 0.2, ["state"])


@add("forecast_seasonal")
def _(spark, sf):
    return fc.seasonal(daily(spark, sf))


@add("forecast_seasonal_weekday_phase")
def _(spark, sf):
    return fc.seasonal(daily(spark, sf), phase="weekday")


@add("seasonal_factors")
def _(spark, sf):
    return fc.seasonal_factors(daily(spark, sf))


@add("future_dates")
def _(spark, sf):
    return s.future_dates(state_days(spark, sf), 30, ["state"])


@add("forecast_by_state")
def _(spark, sf):
    return fc.by_state(lines(spark, sf, "date", "state"), A)


@add("milestones")
def _(spark, sf):
    return fc.milestones(daily(spark, sf), (1_000_000, 25_000_000, 50_000_000))


@add("forecast_summary")
def _(spark, sf):
    return fc.summarize(fc.seasonal(daily(spark, sf)))


@add("forecast_weekend_flags")
def _(spark, sf):
    return fc.mark_weekends(s.future_dates(daily(spark, sf)))


# --- clustering, scoring, learning -------------------------------------------

def placed_districts(spark, sf):
    """District features with a cluster that follows from the district's name."""
    features = g.region_features(lines(spark, sf, *PLACE), A)
    return features.withColumn("cluster", F.ascii(F.split_part("district", F.lit("/"), F.lit(2))))


@add("standardize")
def _(spark, sf):
    columns = sg.region_feature_names(A)
    scaled = sg.standardize(g.region_features(lines(spark, sf, *PLACE), A), columns)
    return scaled.select("state", "district", *[f"{c}_z" for c in columns])


@add("kmeans_regions")
def _(spark, sf):
    placed, _, _ = sg.cluster_regions(lines(spark, sf, *PLACE), A, "district", 5)
    return placed


@add("kmeans_states")
def _(spark, sf):
    _, profiles, _ = sg.cluster_regions(lines(spark, sf, *PLACE), A, "state", 4)
    return profiles


@add("choose_k")
def _(spark, sf):
    features = g.region_features(lines(spark, sf, *PLACE), A)
    return sg.choose_k(sg.scaled_points(features, sg.region_feature_names(A), A.geo_keys("district")))[1]


@add("cluster_profiles")
def _(spark, sf):
    return sg.cluster_profiles(placed_districts(spark, sf), A)


@add("name_clusters")
def _(spark, sf):
    return sg.name_clusters(sg.cluster_profiles(placed_districts(spark, sf), A), A)


@add("underserved")
def _(spark, sf):
    return sg.underserved(lines(spark, sf, *PLACE), A)


@add("service_scores")
def _(spark, sf):
    return sg.service_scores(lines(spark, sf, *PLACE), A)


@add("kmeans_pincodes")
def _(spark, sf):
    return sg.cluster_pincodes(lines(spark, sf, *PLACE), A)[1]


@add("ml_features")
def _(spark, sf):
    return m.ml_features(records(spark, sf), A)


@add("demand_features")
def _(spark, sf):
    return m.demand_features(lines(spark, sf), A)


@add("demand_features_no_leak")
def _(spark, sf):
    return m.demand_features(lines(spark, sf), A, exclude_current=True)


@add("chrono_split")
def _(spark, sf):
    return m.chrono_split(m.demand_features(lines(spark, sf), A)).select("date", "is_train")


@add("demand_model")
def _(spark, sf):
    _, importance, metrics = m.train_demand(lines(spark, sf), A)
    named = metrics.select(F.inline(F.array(
        F.struct(F.lit("metric:mae").alias("feature"), F.col("mae").alias("importance")),
        F.struct(F.lit("metric:r2").alias("feature"), F.col("r2").alias("importance")),
    )))
    return importance.unionByName(named)


@add("surge_label")
def _(spark, sf):
    return m.surge_label(daily(spark, sf))


@add("surge_features")
def _(spark, sf):
    return m.surge_features(lines(spark, sf), A)


@add("random_split")
def _(spark, sf):
    return m.random_split(m.surge_features(lines(spark, sf), A)).select("date", "is_train")


@add("surge_model")
def _(spark, sf):
    return m.train_surge(lines(spark, sf), A)[1]


@add("classification_metrics")
def _(spark, sf):
    rows = m.surge_features(lines(spark, sf), A)
    guess = (F.col("rolling_3_mean") >= F.col("threshold") * 0.8).cast("int")
    return m.classification_metrics(rows.withColumn("guess", guess), "is_surge", "guess")


@add("regression_metrics")
def _(spark, sf):
    return m.regression_metrics(m.demand_features(lines(spark, sf), A), "total", "rolling_7_mean")


@add("district_risk")
def _(spark, sf):
    return m.district_risk(records(spark, sf), A)


@add("risk_summary")
def _(spark, sf):
    return m.risk_summary(m.district_risk(records(spark, sf), A))


@add("importance_features")
def _(spark, sf):
    return m.importance_features(lines(spark, sf), A)


def agreeing(model, rows, columns, *shown, by="date"):
    """Rows with what their walk through the model's trees has in common with the model's own score."""
    scored = model.transform(m._vectors(rows, columns)).select(by, *shown, "prediction")
    return scored.join(m.walked(model, rows, columns, [by]), by).select(
        by, *shown, F.col("n_trees"), (F.abs(F.col("walked") - F.col("prediction")) < 1e-6).alias("agrees"), "prediction"
    )


@add("demand_walk")
def _(spark, sf):
    model, _, _ = m.train_demand(lines(spark, sf), A, trees=20)
    rows = pinned(m.chrono_split(m.demand_features(lines(spark, sf), A)), "demand")
    ends = rows.where("is_train").agg(F.min("total").alias("low"), F.max("total").alias("high"))
    inside = F.col("prediction").between(F.col("low"), F.col("high"))
    found = agreeing(model, rows.where("not is_train"), m.DEMAND_FEATURES, "total")
    return found.join(F.broadcast(ends)).select("date", "total", "n_trees", "agrees", inside.alias("within_training"))


@add("surge_walk")
def _(spark, sf):
    model, _, _ = m.train_surge(lines(spark, sf), A, trees=20)
    rows = pinned(m.random_split(m.surge_features(lines(spark, sf), A)), "surge")
    return agreeing(model, rows.where("not is_train"), m.SURGE_FEATURES, "is_surge").drop("prediction")


@add("importance_walk")
def _(spark, sf):
    model, rows, columns = m.fit_importance(lines(spark, sf), A, trees=20)
    return agreeing(model, rows, columns, "total").drop("prediction")


@add("permuted_features")
def _(spark, sf):
    rows = m.importance_features(lines(spark, sf), A)
    return m.permuted(rows, ("day_of_week", "month", "is_weekend", "pct_a", "pct_b"), repeats=2)


@add("feature_importance")
def _(spark, sf):
    return m.feature_importance(lines(spark, sf), A)


# --- KPIs and chart datasets -------------------------------------------------

@add("kpi_overall")
def _(spark, sf):
    return k.overall(records(spark, sf), A)


@add("kpi_temporal")
def _(spark, sf):
    return k.temporal(lines(spark, sf), A)


@add("kpi_geographic")
def _(spark, sf):
    places = g.total_by(tables.segment_lines(spark, sf, ("state",)), ["state", "district"], "total")
    return k.geographic(pinned(places, "places"), A)


@add("capacity_utilization")
def _(spark, sf):
    return k.capacity_utilization(tables.segment_lines(spark, sf, ("date", "state")), A, 1, 122)


@add("capacity_utilization_qualified")
def _(spark, sf):
    return k.capacity_utilization(tables.segment_lines(spark, sf, ("date", "state")), A, 1, 30, True)


@add("capacity_status_counts")
def _(spark, sf):
    used = k.capacity_utilization(tables.segment_lines(spark, sf, ("date", "state")), A, 1, 122)
    return p.value_counts(used, "capacity_status")


@add("weekday_weekend")
def _(spark, sf):
    return k.weekday_weekend(lines(spark, sf), A)


@add("weekday_breakdown")
def _(spark, sf):
    return k.weekday_breakdown(lines(spark, sf), A)


@add("seasonality_index")
def _(spark, sf):
    return k.seasonality_index(lines(spark, sf), A)


@add("seasonality_extremes")
def _(spark, sf):
    return k.seasonality_extremes(k.seasonality_index(lines(spark, sf), A))


@add("recommendations")
def _(spark, sf):
    kpis = k.merged_kpis(records(spark, sf), A)
    return k.recommendations(kpis, A.measure)


@add("dashboard_kpis")
def _(spark, sf):
    view = e.filter_date_range(lines(spark, sf, *PLACE), "1997-01-01", "1999-12-31", A)
    return k.dashboard_kpis(e.filter_states(view, ["NATION_1", "NATION_2", "NATION_3"], A), A)


@add("trend_with_ma")
def _(spark, sf):
    return k.trend_with_ma(lines(spark, sf), A, "D")


@add("trend_with_ma_weekly")
def _(spark, sf):
    return k.trend_with_ma(lines(spark, sf), A, "W")


@add("trend_with_ma_monthly")
def _(spark, sf):
    return k.trend_with_ma(lines(spark, sf), A, "M")


@add("radar_metrics")
def _(spark, sf):
    return k.radar_metrics(lines(spark, sf, "state", "district", "pincode"), A)


@add("radar_metrics_chosen")
def _(spark, sf):
    return k.radar_metrics(lines(spark, sf, "state", "district", "pincode"), A, ["NATION_0", "NATION_24"])


@add("bubble_dataset")
def _(spark, sf):
    return k.bubble_dataset(lines(spark, sf, "date", "state", "district"), A)


@add("treemap_shares")
def _(spark, sf):
    return k.treemap_shares(lines(spark, sf, "state"), A)


@add("top_states_pct")
def _(spark, sf):
    return k.top_states_pct(lines(spark, sf, "state"), A)


@add("monthly_extremes")
def _(spark, sf):
    return k.monthly_extremes(lines(spark, sf), A)
