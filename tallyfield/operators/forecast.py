"""Forecasts of daily series.

All take a daily series and forecast every series of ``by`` in the same job.
Forecast rows are numbered by ``step`` from 1 and dated from the day after the
last observation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric
from ..spec import DEFAULT, FactSpec
from .aggregate import daily_total
from .rows import present
from .select import top_k
from .series import centered, ordered, whole
from .smoothing import smoothed

# Default targets, interval width and bound factors.
TARGETS = (25_000_000, 50_000_000, 100_000_000)
Z95 = 1.96


def _steps(periods: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")


def _ranked(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """0-based position from the start and length of each series."""
    return daily.withColumns({
        "pos": F.row_number().over(ordered(by)) - 1,
        "n": F.count("*").over(whole(by)),
    })


def moving_average(
    daily: DataFrame, periods: int = 30, window: int = 7, by: Sequence[str] = ()
) -> DataFrame:
    """Last moving average carried on along half the recent trend; bounds -15% and +15%.

    The trend spans ``window - 1`` steps and is divided by ``window``. A series
    shorter than the window has no average, hence a null forecast.
    """
    recent = _ranked(daily, by).where(F.col("pos") >= F.col("n") - window)
    full = F.count("*") == window
    last = recent.groupBy(*by).agg(
        F.max("date").alias("last_date"),
        F.when(full, F.avg("value")).alias("ma"),
        F.when(full, (F.max_by("value", "date") - F.min_by("value", "date")) / window).alias("trend"),
    )
    value = F.col("ma") + F.col("step") * F.col("trend") * 0.5
    return last.select("*", _steps(periods)).select(
        *by, "step", F.date_add("last_date", F.col("step")).alias("date"),
        value.alias("forecast"), (value * 0.85).alias("lower_bound"), (value * 1.15).alias("upper_bound"),
    )


def holt(
    daily: DataFrame,
    periods: int = 30,
    alpha: float = 0.3,
    beta: float = 0.1,
    by: Sequence[str] = (),
) -> DataFrame:
    """Double exponential smoothing; bounds -30% and +30%, nothing below zero."""
    fitted = smoothed(daily, "date", "value", alpha, beta, by)
    value = numeric.clip_lower(F.col("level") + F.col("step") * F.col("trend"))
    return fitted.select("*", _steps(periods)).select(
        *by, "step", F.date_add("last", F.col("step")).alias("date"),
        value.alias("forecast"), (value * 0.7).alias("lower_bound"), (value * 1.3).alias("upper_bound"),
    )


def _detrended(daily: DataFrame, period: int, by: Sequence[str]) -> DataFrame:
    trend = F.avg("value").over(centered(period, by))
    return _ranked(daily, by).withColumn("trend", trend).withColumn(
        "detrended", F.col("value") - F.col("trend")
    )


def _factor_slot(period: int, phase: str) -> Column:
    if phase not in ("position", "weekday"):
        raise ValueError("phase must be 'position' or 'weekday'")
    return (F.col("pos") if phase == "position" else F.weekday("date")) % period


def seasonal_factors(
    daily: DataFrame, period: int = 7, by: Sequence[str] = (), phase: str = "position"
) -> DataFrame:
    """Mean deviation from trend at each phase, centred on their mean.

    By default a phase is the position from the start of the series modulo the
    period; ``phase='weekday'`` takes it from the date instead.
    """
    raw = (
        _detrended(daily, period, by)
        .groupBy(*by, _factor_slot(period, phase).cast("int").alias("slot"))
        .agg(F.avg("detrended").alias("raw"))
    )
    return raw.select(
        *by, "slot", (F.col("raw") - F.avg("raw").over(whole(by))).alias("factor")
    )


def seasonal(
    daily: DataFrame,
    periods: int = 30,
    period: int = 7,
    by: Sequence[str] = (),
    phase: str = "position",
) -> DataFrame:
    """Last trend carried on by its recent slope plus the factor of the day.

    Bounds are 1.96 population deviations of value minus trend. Factors are
    looked up by weekday of the last day plus the step, so with the default
    phase they line up with weekdays only when the series starts on a Monday
    without gaps; ``phase='weekday'`` lines them up always.
    """
    split = _detrended(daily, period, by)
    at = F.col("n") - F.col("pos")
    ends = split.groupBy(*by).agg(
        F.max("date").alias("last_date"),
        F.max("n").alias("n"),
        F.max(F.when(at == 1, F.col("trend"))).alias("trend_last"),
        F.max(F.when(at == period, F.col("trend"))).alias("trend_before"),
        F.stddev_pop("detrended").alias("sigma"),
    )
    slots = F.map_from_entries(F.collect_list(F.struct("slot", "factor"))).alias("factors")
    factors = seasonal_factors(daily, period, by, phase).groupBy(*by).agg(slots)
    if by:
        both = ends.join(factors, list(by))
    else:
        both = ends.withColumn("factors", factors.scalar())
    recent = F.when(F.col("n") > period, (F.col("trend_last") - F.col("trend_before")) / period)
    steps = both.withColumn("recent", F.coalesce(recent, F.lit(0.0))).select("*", _steps(periods))
    slot = ((F.weekday("last_date") + F.col("step")) % period).cast("int")
    value = F.col("trend_last") + F.col("step") * F.col("recent") + F.try_element_at("factors", slot)
    return steps.withColumn("forecast", numeric.clip_lower(value)).select(
        *by, "step", F.date_add("last_date", F.col("step")).alias("date"), "forecast",
        numeric.clip_lower(F.col("forecast") - Z95 * F.col("sigma")).alias("lower_bound"),
        (F.col("forecast") + Z95 * F.col("sigma")).alias("upper_bound"),
    )


def by_state(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    periods: int = 30,
    top_n: int = 10,
    min_points: int = 14,
    phase: str = "position",
) -> DataFrame:
    """Seasonal forecasts of the largest states with more than ``min_points`` days.

    State totals roll up from the state-by-day rows, so the facts are read
    once; the series are forecast side by side.
    """
    series = daily_total(present(df, spec.state), spec, by=[spec.state])
    totals = series.groupBy(spec.state).agg(F.sum("value").alias("total"), F.count("*").alias("days"))
    top = top_k(totals, "total", [spec.state], top_n).where(F.col("days") > min_points)
    # Inner on unique states: a semi join would move below the daily totals and
    # have them computed a second time.
    chosen = series.join(top.select(spec.state), spec.state)
    return seasonal(chosen, periods, by=[spec.state], phase=phase)


def milestones(daily: DataFrame, targets: Sequence[int] = TARGETS, tail: int = 30) -> DataFrame:
    """When the running total reaches each target at the mean of the last rows."""
    latest = F.row_number().over(W.orderBy(F.desc("date")))
    now = daily.withColumn("r", latest).agg(
        F.sum("value").alias("current"), F.max("date").alias("last_date"),
        F.avg(F.when(F.col("r") <= tail, F.col("value"))).alias("pace"),
    )
    reached = F.col("milestone") <= F.col("current")
    left = F.try_divide((F.col("milestone") - F.col("current")).cast("double"), F.col("pace"))
    days = F.when(~reached, F.ceil(left)).try_cast("int")
    return now.select("*", F.explode(F.array(*[F.lit(int(t)).cast("bigint") for t in targets])).alias("milestone")).select(
        "milestone", F.when(reached, "Achieved").otherwise("Projected").alias("status"),
        days.alias("days_from_now"),
        F.date_add("last_date", days).alias("projected_date"),
    ).select("milestone", "status", "projected_date", "days_from_now")


def summarize(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average and total of a forecast, and of its weekend days."""
    weekend = F.weekday("date") >= 5
    return forecast.groupBy(*by).agg(
        F.avg("forecast").alias("avg_forecast"), F.sum("forecast").alias("total_forecast"),
        F.count_if(weekend).alias("weekend_days"),
        F.avg(F.when(weekend, F.col("forecast"))).alias("avg_weekend"),
    )


def mark_weekends(forecast: DataFrame) -> DataFrame:
    return forecast.withColumn("is_weekend", F.weekday("date") >= 5)
