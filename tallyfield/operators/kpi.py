"""KPIs, capacity, seasonality, recommendations and chart datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar, numeric
from ..spec import DEFAULT, FactSpec
from .aggregate import (
    argmax_argmin, cube_and_pincodes, daily_total, district_lifespan, district_total, first_max, first_min,
    gini_column, month_name_total, monthly_total, pincode_total, resample_monthly, resample_weekly,
    share_of_top, state_total, total_by, weekly_total, with_ranks,
)
from .clean import add_shares
from .joins import attach
from .rows import present
from .select import top_states
from .series import strict_mean, whole

# Right-closed capacity bands as (upper bound, label).
CAPACITY_BANDS = ((50.0, "Under-utilized"), (80.0, "Optimal"), (100.0, "Near Capacity"))
OVER_CAPACITY = "Over Capacity"

# Seasonality index limits and staffing texts.
STAFFING = {"low": (90.0, "Reduce Staff"), "high": (110.0, "Add Staff"), "else": "Normal"}


def _side_by_side(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Put one-row frames next to each other."""
    for frame in rest:
        first = attach(first, frame)
    return first


def overall(df: DataFrame, spec: FactSpec = DEFAULT, cube: DataFrame | None = None) -> DataFrame:
    """Twenty headline metrics in one row.

    All but the number of pincodes follow from the day cube. With a cube, ``df`` is anything that
    names the pincodes; without, both are made from the facts, read once.
    """
    m, total = spec.measure, f"total_{spec.measure}"
    if cube is None:
        cube, df = cube_and_pincodes(df, spec)
    facts = cube.agg(
        F.sum(spec.total).alias(total),
        F.min(spec.date).alias("date_range_start"),
        F.max(spec.date).alias("date_range_end"),
        F.count_distinct(spec.date).alias("total_days"),
        F.count_distinct(spec.state).alias("total_states"),
        F.count_distinct(spec.district).alias("total_districts"),
        F.sum("records").alias("total_records"),
        *[
            numeric.percent(F.sum(p), F.sum(spec.total)).alias(f"pct_{label}")
            for p, label in zip(spec.parts, spec.part_labels)
        ],
    )
    pincodes = df.agg(F.count_distinct(spec.pincode).alias("total_pincodes"))
    days = daily_total(cube, spec).agg(
        F.avg("value").alias(f"avg_daily_{m}"), F.median("value").alias(f"median_daily_{m}"),
        F.max("value").alias(f"max_daily_{m}"), F.min("value").alias(f"min_daily_{m}"),
        F.stddev_samp("value").alias(f"std_daily_{m}"),
    )
    return _side_by_side(facts, pincodes, days).withColumns({
        "coefficient_of_variation": numeric.percent(F.col(f"std_daily_{m}"), F.col(f"avg_daily_{m}")),
        f"{m}_per_state": numeric.ratio(F.col(total), F.col("total_states")),
        f"{m}_per_district": numeric.ratio(F.col(total), F.col("total_districts")),
        f"{m}_per_pincode": numeric.ratio(F.col(total), F.col("total_pincodes")),
    })


def temporal(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Weekday against weekend, best and worst month and weekday, monthly spread."""
    daily = daily_total(df, spec)
    weekend = calendar.is_weekend(F.col("date"))
    split = daily.agg(
        F.avg(F.when(~weekend, F.col("value"))).alias("weekday_avg"),
        F.avg(F.when(weekend, F.col("value"))).alias("weekend_avg"),
    ).withColumn(
        "weekend_efficiency",
        F.when(F.col("weekday_avg") > 0, numeric.percent(F.col("weekend_avg"), F.col("weekday_avg")))
        .otherwise(0.0),
    )
    months = total_by(daily, [F.month("date").alias("month")], "value").agg(
        first_max("month", "value").alias("best_month"),
        first_min("month", "value").alias("worst_month"),
        numeric.percent(F.stddev_samp("value"), F.avg("value")).alias("monthly_variance"),
    )
    weekdays = total_by(daily, [F.weekday("date").alias("dow")], "value").agg(
        first_max("dow", "value").alias("best_day_of_week"),
        first_min("dow", "value").alias("worst_day_of_week"),
    )
    return _side_by_side(split, months, weekdays)


def geographic(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Top places, concentration shares, Gini and averages.

    States and districts are grouped apart; from a day cube or a table of place
    totals that costs nothing, from facts it reads them twice.
    """
    places = total_by(df, [spec.state, spec.district], spec.total)
    states = state_total(present(places, spec.state), spec)
    districts = district_total(present(places, spec.district), spec, qualified=False)
    ranked = with_ranks(states, spec.total).agg(
        first_max(spec.state, spec.total).alias("top_state"),
        share_of_top(spec.total, 1).alias("top_state_share"),
        share_of_top(spec.total, 5).alias("top_5_states_share"),
        share_of_top(spec.total, 10).alias("top_10_states_share"),
        gini_column(spec.total).alias("state_gini_coefficient"),
        F.avg(spec.total).alias("avg_per_state"),
    )
    by_name = districts.agg(
        F.avg(spec.total).alias("avg_per_district"),
        first_max(spec.district, spec.total).alias("top_district"),
    )
    return _side_by_side(ranked, by_name)


def capacity_status(utilization: Column) -> Column:
    """Band of a mean utilization; nothing at exactly zero."""
    out = F.when(utilization <= 0, None)
    for upper, label in CAPACITY_BANDS:
        out = out.when(utilization <= upper, label)
    return out.when(utilization.isNotNull(), OVER_CAPACITY)


def capacity_utilization(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    assumed_centers_per_district: int = 5,
    capacity_per_center: int = 100,
    qualified: bool = False,
) -> DataFrame:
    """Mean and peak daily load per district (by name) against an assumed capacity."""
    keys = spec.geo_keys("district") if qualified else [spec.district]
    capacity = float(assumed_centers_per_district * capacity_per_center)
    days = total_by(present(df, *keys), [*keys, spec.date], spec.total)
    used = numeric.percent(F.col(spec.total), F.lit(capacity))
    return (
        days.groupBy(*keys)
        .agg(
            F.avg(spec.total).alias("avg_daily"),
            F.avg(used).alias("avg_utilization"),
            F.max(used).alias("peak_utilization"),
        )
        .withColumn("capacity_status", capacity_status(F.col("avg_utilization")))
    )


def weekday_weekend(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Average, total and days of weekdays and weekends, their gap and the potential."""
    weekend = calendar.is_weekend(F.col("date"))
    sides = []
    for name, cond in (("weekday", ~weekend), ("weekend", weekend)):
        value = F.when(cond, F.col("value"))
        sides += [
            F.avg(value).alias(f"{name}_avg"),
            F.coalesce(F.sum(value), F.lit(0)).alias(f"{name}_total"),
            F.count_if(cond).alias(f"{name}_days"),
        ]
    gap = F.col("weekday_avg") - F.col("weekend_avg")
    return daily_total(df, spec).agg(*sides).withColumns({
        "efficiency_gap": numeric.percent(gap, F.col("weekday_avg")),
        "weekend_potential": gap * F.col("weekend_days"),
    })


def weekday_breakdown(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Mean of the daily totals by day name, highest first."""
    name = F.date_format("date", "EEEE").alias("day_name")
    return (
        daily_total(df, spec).groupBy(name).agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"), "day_name")
    )


def seasonality_index(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Month totals over all years against their mean (= 100), with staffing advice."""
    index = F.round(numeric.percent(F.col("total"), F.avg("total").over(whole())), 2)
    i = F.col("seasonality_index")
    (low, reduce_text), (high, add_text) = STAFFING["low"], STAFFING["high"]
    return (
        month_name_total(df, spec)
        .select("month", F.substring("month_name", 1, 3).alias("month_name"), F.col("value").alias("total"))
        .withColumn("seasonality_index", index)
        .withColumn(
            "recommendation",
            F.when(i < low, reduce_text).when(i > high, add_text).otherwise(STAFFING["else"]),
        )
    )


def seasonality_extremes(index: DataFrame) -> DataFrame:
    """Peak and low month (first in the year on ties)."""
    both = argmax_argmin(index, "seasonality_index", "month")
    return both.select(
        F.col("max_key").alias("peak_month"), F.col("max_value").alias("peak_index"),
        F.col("min_key").alias("low_month"), F.col("min_value").alias("low_index"),
    )


def recommendations(kpis: DataFrame, measure: str = "enrollments") -> DataFrame:
    """Advice from a one-row KPI frame: four conditional rules, two standing ones.

    A metric the frame lacks counts as unremarkable.
    """

    def metric(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in kpis.columns else F.lit(default)

    weekend = metric("weekend_efficiency", 100.0)
    top5 = metric("top_5_states_share", 0.0)
    spread = metric("coefficient_of_variation", 0.0)
    children = metric("pct_age_0_5", 0.0)
    # Rule limits and texts.
    rules = [
        (weekend < 70, "Operations", "High", "Improve Weekend Operations",
         F.format_string(
             f"Weekend {measure} are only %.0f%% of weekday levels. "
             "Consider extended hours or awareness campaigns.", F.bround(weekend, 0)),
         "Increase weekly enrollments by 10-15%"),
        (top5 > 60, "Geographic", "Medium", "Expand Reach in Underserved States",
         F.format_string(
             f"Top 5 states contribute %.0f%% of {measure}. "
             "Focus on increasing capacity in smaller states.", F.bround(top5, 0)),
         "More balanced national coverage"),
        (spread > 30, "Planning", "Medium", "Implement Demand Smoothing",
         F.format_string(
             "High daily variation (CV=%.0f%%) indicates unpredictable demand. "
             "Consider appointment systems.", F.bround(spread, 0)),
         "Reduce wait times and improve resource utilization"),
        (children < 25, "Outreach", "Medium", "Child Enrollment Campaigns",
         F.format_string(
             f"Children (0-5) represent only %.1f%% of {measure}. "
             "Partner with schools and hospitals.", F.bround(children, 1)),
         "Increase child enrollment coverage"),
        (F.lit(True), "Technology", "High", "Deploy Predictive Demand System",
         F.lit("Use ML forecasting to predict daily demand and optimize staffing."),
         "Reduce wait times by 20-30%"),
        (F.lit(True), "Monitoring", "Low", "Implement Real-Time Dashboard",
         F.lit("Deploy interactive dashboard for monitoring KPIs across all centers."),
         "Faster response to operational issues"),
    ]
    table = F.array(*[
        F.struct(
            F.lit(i).alias("position"), when.alias("applies"), F.lit(category).alias("category"),
            F.lit(priority).alias("priority"), F.lit(title).alias("title"),
            description.alias("description"), F.lit(impact).alias("potential_impact"),
        )
        for i, (when, category, priority, title, description, impact) in enumerate(rules, 1)
    ])
    return kpis.select(F.inline(table)).where("applies").drop("applies").orderBy("position")


def merged_kpis(df: DataFrame, spec: FactSpec = DEFAULT, cube: DataFrame | None = None) -> DataFrame:
    """All three KPI rows side by side, from one day cube; without one the facts are read once for it and the pincodes."""
    if cube is None:
        cube, df = cube_and_pincodes(df, spec)
    return _side_by_side(overall(df, spec, cube), temporal(cube, spec), geographic(cube, spec))


def dashboard_kpis(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Total, daily average, active districts and the top pincode of a filtered view, read once."""
    cube, pincodes = cube_and_pincodes(df, spec)
    totals = cube.agg(
        F.sum(spec.total).alias("total"), F.count_distinct(spec.district).alias("active_districts")
    )
    daily = daily_total(cube, spec).agg(F.avg("value").alias("avg_daily"))
    top = pincode_total(pincodes, spec).orderBy(F.desc(spec.total), spec.pincode).limit(1).select(
        F.col(spec.pincode).alias("top_pincode")
    )
    return _side_by_side(totals, daily, top)


def trend_with_ma(df: DataFrame, spec: FactSpec = DEFAULT, granularity: str = "D") -> DataFrame:
    """Daily, weekly or monthly series with a full-window moving average (7, else 3)."""
    build = {"D": daily_total, "W": resample_weekly, "M": resample_monthly}
    if granularity not in build:
        raise ValueError("granularity must be D, W or M")
    window = 7 if granularity == "D" else 3
    return build[granularity](df, spec).withColumn("ma", strict_mean(window))


def radar_metrics(
    df: DataFrame, spec: FactSpec = DEFAULT, states: Sequence[str] | None = None, n: int = 5
) -> DataFrame:
    """Six measures per state, each scaled so that the largest shown is 100."""
    rows = df.where(F.col(spec.state).isin(*states)) if states else present(df, spec.state)
    # one rollup of the facts; a pincode counts where it stands first in its state, and districts are counted by a second rollup
    places = rows.groupBy(spec.state, spec.district, spec.pincode).agg(*[F.sum(c).alias(c) for c in spec.measures])
    first = F.row_number().over(W.partitionBy(spec.state, spec.pincode).orderBy(spec.district)) == 1
    districts = places.withColumn("_first", first & F.col(spec.pincode).isNotNull()).groupBy(spec.state, spec.district).agg(
        *[F.sum(c).alias(c) for c in spec.measures], F.count_if("_first").alias("_pins")
    )
    grouped = districts.groupBy(spec.state).agg(
        *[F.sum(c).alias(c) for c in spec.measures], F.count(spec.district).alias("districts"), F.sum("_pins").alias("pincodes")
    )
    if not states:
        grouped = grouped.orderBy(F.desc(spec.total), spec.state).limit(n)
    shown = add_shares(grouped, spec, keep_null=True).withColumn("volume", F.col(spec.total))
    measures = ("volume", *spec.share_names, "districts", "pincodes")
    return shown.select(
        spec.state,
        *[(numeric.ratio(F.col(c), F.max(c).over(whole())) * 100).alias(c) for c in measures],
    )


def bubble_dataset(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 30) -> DataFrame:
    """Largest districts with history: pace, children's share and bubble size."""
    top = district_lifespan(df, spec).orderBy(F.desc("total"), *spec.geo_keys("district")).limit(n)
    size = numeric.ratio(F.col("total"), F.max("total").over(whole())) * 1000 + 50
    return top.withColumn("size", size)


def treemap_shares(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 15) -> DataFrame:
    """Top states with their share of the shown total."""
    shown = F.sum(spec.total).over(whole())
    return top_states(df, spec, n).withColumn("pct", numeric.percent(F.col(spec.total), shown))


def top_states_pct(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 15) -> DataFrame:
    """Top states with their share of the grand total."""
    totals = state_total(present(df, spec.state), spec)
    grand = totals.agg(F.sum(spec.total)).scalar()
    return totals.orderBy(F.desc(spec.total), spec.state).limit(n).withColumn(
        "pct", numeric.percent(F.col(spec.total), grand)
    )


def monthly_extremes(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Peak and low month, mean and number of weeks."""
    extremes = argmax_argmin(monthly_total(df, spec), "value", "month").select(
        F.col("max_key").alias("peak_month"), F.col("max_value").alias("peak_value"),
        F.col("min_key").alias("low_month"), F.col("min_value").alias("low_value"),
    )
    weeks = weekly_total(df, spec).agg(
        F.avg("value").alias("weekly_mean"), F.count("*").alias("weeks")
    )
    return _side_by_side(extremes, weeks)
