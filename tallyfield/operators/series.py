"""Ordered-series operators.

They take a series of (``by``, date, value) rows: one row per day or period, so
a series is as long as its calendar and never as long as the facts. ``by``
names the series keys; many series run side by side in one job.

The scaling functions at the end take a set of states or districts, whose size
the geography fixes. They use a window over the set rather than a second
aggregate, so the facts below are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions import numeric
from .ranking import ranked

# Totals whose days are looked for.
MILESTONES = (1_000_000, 5_000_000, 10_000_000, 20_000_000)


def ordered(by: Sequence[str] = (), order: str = "date") -> WindowSpec:
    return W.partitionBy(*by).orderBy(order)


def whole(by: Sequence[str] = ()) -> WindowSpec:
    return W.partitionBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def trailing(w: int, by: Sequence[str] = (), order: str = "date") -> WindowSpec:
    return ordered(by, order).rowsBetween(-(w - 1), 0)


def centered(w: int, by: Sequence[str] = (), order: str = "date") -> WindowSpec:
    return ordered(by, order).rowsBetween(-(w // 2), (w - 1) // 2)


def zscore_column(by: Sequence[str] = (), value: str = "value") -> Column:
    """(x - mean) / sample deviation over the series."""
    c = F.col(value)
    return numeric.ratio(c - F.avg(c).over(whole(by)), F.stddev_samp(c).over(whole(by)))


def zscore(series: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    return series.withColumn("z_score", zscore_column(by, value))


def strict_mean(w: int, by: Sequence[str] = (), value: str = "value", order: str = "date") -> Column:
    """Trailing mean, null until the window is full."""
    frame = trailing(w, by, order)
    return F.when(F.count(value).over(frame) == w, F.avg(value).over(frame))


def rolling_mean(series: DataFrame, w: int = 7, by: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Trailing mean over what is there."""
    return series.withColumn(f"mean_{w}", F.avg("value").over(trailing(w, by, order)))


def rolling_mean_strict(
    series: DataFrame, w: int = 7, by: Sequence[str] = (), order: str = "date"
) -> DataFrame:
    return series.withColumn(f"mean_{w}", strict_mean(w, by, order=order))


def rolling_std(series: DataFrame, w: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Trailing sample deviation, null on the first row."""
    return series.withColumn(f"std_{w}", F.stddev_samp("value").over(trailing(w, by)))


def centered_mean(series: DataFrame, w: int = 7, by: Sequence[str] = ()) -> DataFrame:
    return series.withColumn("trend", F.avg("value").over(centered(w, by)))


def lag_features(
    series: DataFrame, lags: Sequence[int] = (1, 7, 14), by: Sequence[str] = (), value: str = "value"
) -> DataFrame:
    """Values of so many rows before."""
    return series.withColumns({f"lag_{k}": F.lag(value, k).over(ordered(by)) for k in lags})


def cumulative_sum(series: DataFrame, by: Sequence[str] = (), order: str = "date") -> DataFrame:
    frame = ordered(by, order).rowsBetween(W.unboundedPreceding, 0)
    return series.withColumn("cumulative", F.sum("value").over(frame))


def pct_change(monthly: DataFrame, by: Sequence[str] = (), order: str = "month") -> DataFrame:
    """Growth on the previous period that is present, in percent."""
    before = F.lag("value").over(ordered(by, order))
    return monthly.withColumn("growth_pct", numeric.percent(F.col("value") - before, before))


def growth_summary(monthly: DataFrame, order: str = "month") -> DataFrame:
    """Average, highest and lowest growth."""
    return pct_change(monthly, order=order).agg(
        F.avg("growth_pct").alias("avg_growth"),
        F.max("growth_pct").alias("max_growth"),
        F.min("growth_pct").alias("min_growth"),
    )


def month_waterfall(monthly: DataFrame, order: str = "month") -> DataFrame:
    """Change on the previous month with the position of its floating bar."""
    start = F.lag("value").over(ordered((), order))
    return (
        monthly.withColumn("start", start)
        .where(F.col("start").isNotNull())
        .select(
            order, "start", F.col("value").alias("end"),
            (F.col("value") - F.col("start")).alias("change"),
            F.least("start", "value").alias("bottom"),
            F.abs(F.col("value") - F.col("start")).alias("height"),
        )
    )


def run_ids(
    series: DataFrame, flag: str, by: Sequence[str] = (), out: str = "run_id", order: str = "date"
) -> DataFrame:
    """Number the runs of equal flags; the first row starts run 1."""
    changed = ~F.col(flag).eqNullSafe(F.lag(flag).over(ordered(by, order)))
    frame = ordered(by, order).rowsBetween(W.unboundedPreceding, 0)
    return (
        series.withColumn("_new", changed.cast("int"))
        .withColumn(out, F.sum("_new").over(frame))
        .drop("_new")
    )


def pareto(totals: DataFrame, value: str, key: str, reach: float = 80.0) -> DataFrame:
    """Cumulative share, largest first, and the position that reaches ``reach`` percent, over any number of keys."""
    places = ranked(totals.select(key, value), [F.desc(value), F.asc(key)], "position", {"_upto": value}, {"_all": value})
    shares = places.select(
        key, value, F.col("position").cast("int").alias("position"), numeric.percent(F.col("_upto"), F.col("_all")).alias("cumulative_pct")
    )
    first = shares.agg(F.min(F.when(F.col("cumulative_pct") >= reach, F.col("position")))).scalar()
    return shares.withColumn("reached_at", first)


def threshold_crossing(
    daily: DataFrame, milestones: Sequence[int] = MILESTONES
) -> DataFrame:
    """First day on which the running total reaches each milestone."""
    run = cumulative_sum(daily)
    rows = [
        F.struct(
            F.lit(m).cast("bigint").alias("milestone"),
            F.min(F.when(F.col("cumulative") >= m, F.col("date"))).alias("date"),
        )
        for m in milestones
    ]
    return run.agg(F.array(*rows).alias("s")).select(F.inline("s")).where(F.col("date").isNotNull())


def minmax_column(c: str) -> Column:
    """(x - min) / (max - min) over a set of regions, null for a constant."""
    low, high = F.min(c).over(whole()), F.max(c).over(whole())
    return numeric.ratio(F.col(c) - low, high - low)


def max_column(c: str) -> Column:
    """x / max over a set of regions."""
    return numeric.ratio(F.col(c), F.max(c).over(whole()))


def quantile_column(c: str, p: float) -> Column:
    """Linear quantile over a set of regions."""
    return F.percentile(c, F.lit(p)).over(whole())


def minmax_scale(df: DataFrame, c: str, out: str) -> DataFrame:
    return df.withColumn(out, minmax_column(c))


def max_scale(df: DataFrame, c: str, out: str, scale: float = 1.0) -> DataFrame:
    return df.withColumn(out, max_column(c) * scale)


def cap_at_quantile(df: DataFrame, c: str, p: float = 0.95, out: str | None = None) -> DataFrame:
    """Clip the upper tail at a quantile; nulls stay null."""
    return df.withColumn(out or c, numeric.cap(F.col(c), quantile_column(c, p)))


def tail_mean(daily: DataFrame, rows: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the last rows of the series (rows, not calendar days)."""
    latest = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("date")))
    last = daily.withColumn("_r", latest).where(F.col("_r") <= rows)
    return last.groupBy(*by).agg(F.avg("value").alias("tail_mean"), F.count("*").alias("rows"))


def future_dates(daily: DataFrame, periods: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """The days after the last one of each series, numbered from 1."""
    last = daily.groupBy(*by).agg(F.max("date").alias("last_date"))
    return last.select(
        *by, "last_date", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
    ).select(*by, "step", F.date_add("last_date", F.col("step")).alias("date"))
