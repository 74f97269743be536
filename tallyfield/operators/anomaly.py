"""Anomaly detection on daily series, places and holidays.

Series detectors take a daily series (see ``aggregate.daily_total``) and run on
any number of series at once through ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..sources.scratch import pinned
from ..spec import DEFAULT, FactSpec
from . import joins
from .aggregate import geo_profile, pincode_profile
from .quantile import average_rank_percent
from .select import top_k
from .series import centered, run_ids, trailing, whole, zscore_column


def _band(value: Column, low: Column, high: Column) -> dict[str, Column]:
    """Flag and label of values strictly outside a band."""
    return {
        "is_anomaly": F.coalesce((value > high) | (value < low), F.lit(False)),
        "anomaly_type": F.when(value > high, "High").when(value < low, "Low").otherwise("Normal"),
    }


def zscore_daily(daily: DataFrame, threshold: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Every day with its z-score, flag and High / Low / Normal label."""
    z = F.col("z_score")
    return daily.withColumn("z_score", zscore_column(by)).withColumns(
        _band(z, F.lit(-float(threshold)), F.lit(float(threshold)))
    )


def detect_zscore(daily: DataFrame, threshold: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Days beyond ``threshold`` deviations, with their deviation from the mean in percent."""
    mean = F.avg("value").over(whole(by))
    return (
        zscore_daily(daily.withColumn("_mean", mean), threshold, by)
        .where("is_anomaly")
        .withColumn(
            "deviation_pct", F.round(numeric.percent(F.col("value") - F.col("_mean"), F.col("_mean")), 2)
        )
        .drop("_mean")
    )


def iqr_daily(daily: DataFrame, multiplier: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    """Every day with the quartile fences, flag and label."""
    q1 = F.percentile("value", F.lit(0.25)).over(whole(by))
    q3 = F.percentile("value", F.lit(0.75)).over(whole(by))
    fenced = daily.withColumns({"_q1": q1, "_q3": q3}).withColumns({
        "lower_bound": F.col("_q1") - multiplier * (F.col("_q3") - F.col("_q1")),
        "upper_bound": F.col("_q3") + multiplier * (F.col("_q3") - F.col("_q1")),
    })
    return fenced.drop("_q1", "_q3").withColumns(
        _band(F.col("value"), F.col("lower_bound"), F.col("upper_bound"))
    )


def detect_iqr(daily: DataFrame, multiplier: float = 1.5, by: Sequence[str] = ()) -> DataFrame:
    return iqr_daily(daily, multiplier, by).where("is_anomaly")


def deviation_daily(
    daily: DataFrame, window: int = 7, threshold: float = 2.0, by: Sequence[str] = ()
) -> DataFrame:
    """Every day against its trailing mean, with the run of equal flags it is in."""
    frame = trailing(window, by)
    marked = daily.withColumns({
        "ma": F.avg("value").over(frame), "std": F.stddev_samp("value").over(frame),
    }).withColumn("deviation", numeric.ratio(F.col("value") - F.col("ma"), F.col("std")))
    flag = F.coalesce(F.abs("deviation") > threshold, F.lit(False))
    return run_ids(marked.withColumn("is_deviant", flag), "is_deviant", by)


def detect_runs(
    daily: DataFrame,
    window: int = 7,
    threshold: float = 2.0,
    min_consecutive: int = 3,
    by: Sequence[str] = (),
) -> DataFrame:
    """Sustained periods: runs of deviant rows of at least ``min_consecutive``."""
    return (
        deviation_daily(daily, window, threshold, by)
        .where("is_deviant")
        .groupBy(*by, "run_id")
        .agg(
            F.min("date").alias("start_date"), F.max("date").alias("end_date"),
            F.count("*").alias("duration"),
            F.avg("deviation").alias("avg_deviation"), F.avg("value").alias("avg_value"),
        )
        .where(F.col("duration") >= min_consecutive)
    )


def seasonal_decompose(daily: DataFrame, period: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Trend, weekday component and residual of every day, with a 2.5-sigma flag.

    The seasonal part is by weekday whatever the period is.
    """
    split = daily.withColumn("trend", F.avg("value").over(centered(period, by))).withColumn(
        "_detrended", F.col("value") - F.col("trend")
    )
    split = joins.lookup_weekday_mean(split, "_detrended", "seasonal", by).withColumn(
        "residual", F.col("value") - F.col("trend") - F.col("seasonal")
    )
    distance = F.abs(F.col("residual") - F.avg("residual").over(whole(by)))
    limit = 2.5 * F.stddev_samp("residual").over(whole(by))
    return split.withColumn("is_residual_anomaly", F.coalesce(distance > limit, F.lit(False))).select(
        *by, "date", F.col("value").alias("original"), "trend", "seasonal", "residual",
        "is_residual_anomaly",
    )


def residual_anomalies(daily: DataFrame, period: int = 7, by: Sequence[str] = ()) -> DataFrame:
    return seasonal_decompose(daily, period, by).where("is_residual_anomaly")


def geo_scores(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    level: str = "state",
    threshold: float = 2.0,
    pincodes: DataFrame | None = None,
) -> DataFrame:
    """Per place: volume per day and per pincode, both z-scores, performer flags."""
    per_day, per_pin = f"{spec.measure}_per_day", f"{spec.measure}_per_pincode"
    places = geo_profile(df, spec, level, pincodes).withColumns({
        per_day: numeric.ratio(F.col(spec.total), F.col("active_days")),
        per_pin: numeric.ratio(F.col(spec.total), F.col("unique_pincodes")),
    })
    scored = places.withColumns({f"{c}_zscore": zscore_column((), c) for c in (per_day, per_pin)})
    z = F.col(f"{per_day}_zscore")
    return scored.withColumns({
        "is_high_performer": F.coalesce(z > threshold, F.lit(False)),
        "is_low_performer": F.coalesce(z < -threshold, F.lit(False)),
    }).withColumn("is_anomaly", F.col("is_high_performer") | F.col("is_low_performer"))


def detect_geographic(
    df: DataFrame, spec: FactSpec = DEFAULT, level: str = "state", threshold: float = 2.0
) -> DataFrame:
    """Places whose volume per day stands out."""
    return geo_scores(df, spec, level, threshold).where("is_anomaly")


def pincode_scores(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Every pincode with its daily average and percentile of the total.

    The ranking needs the pincode totals twice, so the profile is pinned and
    the facts are read once.
    """
    keys = spec.geo_keys("pincode")
    profile = pinned(pincode_profile(df, spec).select(*keys, spec.total, "active_days"), "pincodes")
    profile = profile.withColumn(
        "daily_avg", numeric.ratio(F.col(spec.total), F.col("active_days"))
    )
    return average_rank_percent(profile, spec.total, "percentile")


def detect_pincodes(df: DataFrame, spec: FactSpec = DEFAULT, top_n: int = 50) -> DataFrame:
    """The largest and the smallest ``top_n`` pincodes, marked ``top`` and ``bottom``."""
    scored = pincode_scores(df, spec)
    keys = spec.geo_keys("pincode")
    top = top_k(scored, spec.total, keys, top_n).withColumn("side", F.lit("top"))
    bottom = top_k(scored, spec.total, keys, top_n, smallest=True).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def holiday_baseline(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    """Mean of the days that are not holidays."""
    return joins.holiday_anti(daily, holidays).agg(F.avg("value").alias("baseline"))


def holiday_impact(
    daily: DataFrame, holidays: DataFrame, spec: FactSpec = DEFAULT, days: int = 3
) -> DataFrame:
    """Each holiday in the data against the baseline and its neighbouring days."""
    present = joins.holiday_lookup(daily, holidays)
    base = holiday_baseline(daily, holidays).scalar()
    around = joins.interval_neighbors(daily, present, days).groupBy(
        F.col("anchor").alias("date")
    ).agg(
        F.avg(F.when(F.col("offset") < 0, F.col("value"))).alias("avg_before"),
        F.avg(F.when(F.col("offset") > 0, F.col("value"))).alias("avg_after"),
    )
    recovered = F.col("avg_after") > F.col("avg_before") * 0.9
    return (
        present.withColumn("baseline", base)
        .join(around, "date", "left")
        .select(
            "date", "holiday", F.col("value").alias(spec.measure), "baseline",
            F.round(numeric.percent(F.col("value") - F.col("baseline"), F.col("baseline")), 2).alias(
                "impact_pct"
            ),
            "avg_before", "avg_after",
            F.when(recovered, 1).otherwise(2).alias("recovery_days"),
        )
    )


def holiday_mean_impact(impact: DataFrame) -> DataFrame:
    return impact.agg(F.avg("impact_pct").alias("avg_impact"), F.count("*").alias("holidays"))


def control_limits(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every day with control (3 sigma) and warning (2 sigma) limits and its zone."""
    mean, std = F.avg("value").over(whole(by)), F.stddev_samp("value").over(whole(by))
    limits = daily.withColumns({"mean": mean, "std": std})
    m, s = F.col("mean"), F.col("std")
    limits = limits.withColumns({
        "ucl": m + 3 * s, "lcl": numeric.clip_lower(m - 3 * s),
        "uwl": m + 2 * s, "lwl": numeric.clip_lower(m - 2 * s),
    })
    v = F.col("value")
    out = (v > F.col("ucl")) | (v < F.col("lcl"))
    warn = (v > F.col("uwl")) | (v < F.col("lwl"))
    return limits.withColumn(
        "zone", F.when(out, "out_of_control").when(warn, "warning").otherwise("in_control")
    ).drop("std")
