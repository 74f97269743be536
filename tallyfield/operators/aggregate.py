"""Grouped totals, profiles, pivots and concentration measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar, numeric
from ..sources.scratch import pinned
from ..spec import DEFAULT, FactSpec
from . import quantile
from .clean import add_shares, drop_numeric_names
from .rows import present


def total_by(
    df: DataFrame, keys: Sequence[str | Column], column: str, out: str | None = None
) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(column).alias(out or column))


def day_cube(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """The facts rolled up to (date, state, district), with record count and sum of squares.

    It keeps the fact columns' names, so every operator made of sums takes the
    cube in place of the facts. Its size is days times districts.
    """
    t = F.col(spec.total)
    return df.groupBy(spec.date, spec.state, spec.district).agg(
        *[F.sum(c).alias(c) for c in spec.measures],
        F.count("*").alias("records"), F.sum(numeric.square(t)).alias("squares"),
    )


def daily_total(
    df: DataFrame, spec: FactSpec = DEFAULT, column: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """The daily series (``by``, date, value)."""
    return total_by(
        df.where(F.col(spec.date).isNotNull()),
        [*by, F.col(spec.date).alias("date")], column or spec.total, "value",
    )


def monthly_total(df: DataFrame, spec: FactSpec = DEFAULT, column: str | None = None) -> DataFrame:
    """Sum by month; months without rows do not appear."""
    month = calendar.month_start(F.col(spec.date)).alias("month")
    return total_by(present(df, spec.date), [month], column or spec.total, "value")


def weekly_total(df: DataFrame, spec: FactSpec = DEFAULT, column: str | None = None) -> DataFrame:
    """Sum by Monday-to-Sunday week; weeks without rows do not appear."""
    week = calendar.week_start(F.col(spec.date)).alias("week")
    return total_by(present(df, spec.date), [week], column or spec.total, "value")


def _resample(totals: DataFrame, key: str, step: str, label: Column) -> DataFrame:
    """Fill the gaps of a period series with zeros and label by period end."""
    periods = totals.agg(F.min(key).alias("a"), F.max(key).alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(key)
    )
    return periods.join(totals, key, "left").select(
        label.alias("date"), F.coalesce("value", F.lit(0)).alias("value")
    )


def resample_weekly(df: DataFrame, spec: FactSpec = DEFAULT, column: str | None = None) -> DataFrame:
    """Weekly sums labelled by their Sunday, empty weeks as 0."""
    return _resample(weekly_total(df, spec, column), "week", "7 days", F.date_add("week", 6))


def resample_monthly(df: DataFrame, spec: FactSpec = DEFAULT, column: str | None = None) -> DataFrame:
    """Monthly sums labelled by the last day, empty months as 0."""
    return _resample(monthly_total(df, spec, column), "month", "1 month", F.last_day("month"))


def state_total(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    return total_by(present(df, spec.state), [spec.state], spec.total)


def district_total(df: DataFrame, spec: FactSpec = DEFAULT, qualified: bool = True) -> DataFrame:
    """Sum by district; ``qualified=False`` merges districts of the same name."""
    keys = spec.geo_keys("district") if qualified else [spec.district]
    return total_by(present(df, *keys), keys, spec.total)


def pincode_total(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Sum by pincode; rows without one drop out."""
    return total_by(df.where(F.col(spec.pincode).isNotNull()), [spec.pincode], spec.total)


def part_totals(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Sum of each part and its share of the total."""
    whole = F.sum(spec.total)
    rows = [
        F.struct(
            F.lit(p).alias("part"), F.sum(p).alias("value"),
            numeric.share(F.sum(p), whole).alias("share_pct"),
        )
        for p in spec.parts
    ]
    return df.agg(F.array(*rows).alias("s")).select(F.inline("s"))


def monthly_part_totals(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    month = calendar.month_start(F.col(spec.date)).alias("month")
    return present(df, spec.date).groupBy(month).agg(*[F.sum(p).alias(p) for p in spec.parts])


def weekday_frame(df: DataFrame) -> DataFrame:
    """The seven weekdays as rows, Monday = 0."""
    days = F.array(*[F.struct(F.lit(i).alias("day_of_week"), F.lit(n).alias("day_name"))
                     for i, n in enumerate(calendar.WEEKDAYS)])
    return df.sparkSession.range(1).select(F.inline(days))


def weekday_total(df: DataFrame, spec: FactSpec = DEFAULT, fill: int | None = None) -> DataFrame:
    """Sum per weekday, Monday first, absent days kept, with an above-average flag."""
    day = calendar.day_of_week(F.col(spec.date)).alias("day_of_week")
    totals = total_by(df, [day], spec.total, "value")
    value = F.col("value") if fill is None else F.coalesce("value", F.lit(fill))
    mean = F.avg("value").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return (
        weekday_frame(df).join(totals, "day_of_week", "left")
        .withColumn("value", value)
        .withColumn("above_average", F.col("value") > mean)
    )


def weekday_mean(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Mean per record of each weekday."""
    name = calendar.calendar_columns(F.col(spec.date))["day_name"].alias("day_name")
    return present(df, spec.date).groupBy(name).agg(F.avg(spec.total).alias("mean"))


def month_name_total(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Sum by calendar month over all years, in calendar order."""
    month = F.month(spec.date)
    return (
        total_by(present(df, spec.date), [month.alias("month")], spec.total, "value")
        .select("month", _month_name(F.col("month")).alias("month_name"), "value")
        .orderBy("month")
    )


def _month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in calendar.MONTHS]), month)


def quarter_total(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Sum by quarter, flagging the best and the worst (first on ties)."""
    totals = total_by(present(df, spec.date), [F.quarter(spec.date).alias("quarter")], spec.total, "value")
    best = F.row_number().over(W.orderBy(F.desc("value"), "quarter")) == 1
    worst = F.row_number().over(W.orderBy("value", "quarter")) == 1
    return totals.withColumns({"is_best": best, "is_worst": worst})


def state_part_totals(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 10) -> DataFrame:
    """Part sums and shares of the ``n`` largest states.

    The top ``n`` are picked from the grouped rows, so the facts are read once.
    """
    sums = present(df, spec.state).groupBy(spec.state).agg(*[F.sum(c).alias(c) for c in spec.measures])
    return add_shares(sums.orderBy(F.desc(spec.total), spec.state).limit(n), spec)


def cube_and_pincodes(df: DataFrame, spec: FactSpec = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The day cube, and the sums of each pincode, from one read of the facts: both are made by one aggregate and pinned together.

    Each fact enters two groups, which partial aggregation folds before anything is shuffled.
    """
    place, t = [spec.date, spec.state, spec.district], F.col(spec.total)
    both = df.groupingSets([place, [spec.pincode]], *place, spec.pincode).agg(
        *[F.sum(c).alias(c) for c in spec.measures], F.count("*").alias("records"), F.sum(numeric.square(t)).alias("squares"),
        F.grouping(spec.pincode).alias("_of_place"),
    )
    held = pinned(both, "cube-and-pincodes")
    cube = held.where("_of_place = 1").drop(spec.pincode, "_of_place")
    return cube, held.where("_of_place = 0").select(spec.pincode, *spec.measures)


#: The days of a year as a set: one bit a day, in so many 64-bit words.
DAY_WORDS = [f"days_{k}" for k in range(6)]


def day_sets(df: DataFrame, keys: Sequence[str], spec: FactSpec = DEFAULT) -> DataFrame:
    """The facts rolled up to (keys, pincode, year), with record count, sum of squares and the set of their days.

    Sets merge by ``bit_or`` and are counted by ``bit_count``, so active days of any coarser place follow from the
    rollup, as sums do. Aggregates of plain numbers are combined on the map side; no row is copied for a distinct count.
    """
    d, t = F.col(spec.date), F.col(spec.total)
    at = F.dayofyear(d) - 1
    bits = {
        name: F.coalesce(F.bit_or(F.when(F.shiftright(at, 6) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64))))), F.lit(0).cast("bigint"))
        for k, name in enumerate(DAY_WORDS)
    }
    return df.groupBy(*keys, spec.pincode, F.year(d).alias("_year")).agg(
        *[F.sum(c).alias(c) for c in spec.measures], F.count(t).alias("records"), F.sum(numeric.square(t)).alias("squares"),
        *[c.alias(name) for name, c in bits.items()],
    )


def from_day_sets(sets: DataFrame, keys: Sequence[str], sums: Sequence[str], spec: FactSpec = DEFAULT, pincode_name: str = "unique_pincodes") -> DataFrame:
    """Sums, active days and distinct pincodes of the places named by ``keys`` from a rollup of day sets.

    A pincode counts where it stands first in its place, so one chain of aggregates gives both counts.
    """
    first = F.row_number().over(W.partitionBy(*keys, spec.pincode).orderBy("_year")) == 1
    years = sets.withColumn("_first", first & F.col(spec.pincode).isNotNull()).groupBy(*keys, "_year").agg(
        *[F.sum(c).alias(c) for c in sums], F.count_if("_first").alias("_pins"), *[F.bit_or(w).alias(w) for w in DAY_WORDS]
    )
    return years.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.sum(_days_of_year()).alias("active_days"), F.sum("_pins").alias(pincode_name))


def _days_of_year() -> Column:
    """How many days a set holds."""
    return sum((F.bit_count(w) for w in DAY_WORDS[1:]), F.bit_count(DAY_WORDS[0]))


def _place_groups(
    df: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str],
    spec: FactSpec,
    pincodes: DataFrame | None,
    pincode_name: str = "unique_pincodes",
) -> DataFrame:
    """Sums, active days and distinct pincodes per place.

    From facts alone both counts come from one rollup of day sets, read once. With ``df`` a day
    cube, ``pincodes`` supplies the places of each pincode.
    """
    if pincodes is None:
        return from_day_sets(day_sets(df, keys, spec), keys, sums, spec, pincode_name)
    grouped = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.count_distinct(spec.date).alias("active_days"))
    pins = F.count_distinct(spec.pincode).alias(pincode_name)
    return grouped.join(pincodes.groupBy(*keys).agg(pins), list(keys), "left").fillna(0, [pincode_name])


def geo_profile(
    df: DataFrame, spec: FactSpec = DEFAULT, level: str = "state", pincodes: DataFrame | None = None
) -> DataFrame:
    """Total, active days and distinct pincodes per place (by name alone)."""
    key = {"state": spec.state, "district": spec.district}[level]
    return _place_groups(df.where(F.col(key).isNotNull()), [key], [spec.total], spec, pincodes)


def pincode_profile(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Sums and active days per (pincode, state, district), from day sets."""
    keys = spec.geo_keys("pincode")
    return day_sets(present(df, *keys), [spec.state, spec.district], spec).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in spec.measures],
        F.sum(_days_of_year()).alias("active_days"),
    )


def region_features(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    level: str = "district",
    pincodes: DataFrame | None = None,
) -> DataFrame:
    """Volume, activity, shares and averages per district or state."""
    total = F.col(spec.total)
    pins = None if pincodes is None else drop_numeric_names(pincodes, spec)
    grouped = _place_groups(drop_numeric_names(df, spec), spec.geo_keys(level), (spec.total, *spec.parts), spec, pins)
    return add_shares(grouped, spec).withColumns({
        "daily_avg": numeric.ratio(total, F.col("active_days")),
        "per_pincode_avg": numeric.ratio(total, F.col("unique_pincodes")),
    })


def district_volatility(
    df: DataFrame, spec: FactSpec = DEFAULT, pincodes: DataFrame | None = None
) -> DataFrame:
    """Total, per-record mean and deviation, active days and pincodes per district.

    Mean and deviation come from integer sums, so they are exact, the same on
    every evaluation, and roll up from a day cube.
    """
    pins = None if pincodes is None else drop_numeric_names(pincodes, spec)
    if pins is not None and "squares" not in df.columns:
        df = day_cube(df, spec)
    sums = _place_groups(
        drop_numeric_names(df, spec), spec.geo_keys("district"), (spec.total, "squares", "records"), spec, pins, "pincodes"
    )
    records, total, squares = F.col("records"), F.col(spec.total), F.col("squares")
    return sums.select(
        *spec.geo_keys("district"), total.alias("total"),
        numeric.ratio(total, records).alias("daily_mean"),
        numeric.stddev_from_sums(records, total, squares).alias("daily_std"),
        "active_days", "pincodes",
    )


def district_lifespan(df: DataFrame, spec: FactSpec = DEFAULT, min_days: int = 7) -> DataFrame:
    """First and last day, total and children's share of districts with history."""
    first = spec.parts[0]
    return (
        present(df, *spec.geo_keys("district")).groupBy(*spec.geo_keys("district"))
        .agg(
            F.sum(spec.total).alias("total"), F.sum(first).alias("children"),
            F.min(spec.date).alias("start"), F.max(spec.date).alias("end"),
            F.count_distinct(spec.date).alias("days"),
        )
        .where(F.col("days") > min_days)
        .withColumns({
            "daily_avg": numeric.ratio(F.col("total"), F.col("days")),
            "children_pct": numeric.percent(F.col("children"), F.col("total")),
        })
    )


def daily_with_calendar(
    df: DataFrame, spec: FactSpec = DEFAULT, columns: Sequence[str] | None = None
) -> DataFrame:
    """Daily sums with the calendar attributes and flags of each day.

    Attributes depend on the date alone, so they are worked out once per day
    after the aggregation rather than carried through it.
    """
    columns = list(columns or [spec.total])
    d = F.col("date")
    cal = calendar.calendar_columns(d)
    return (
        present(df, spec.date).groupBy(F.col(spec.date).alias("date"))
        .agg(*[F.sum(c).alias(c) for c in columns])
        .withColumns({
            **{k: cal[k] for k in ("day_of_week", "month", "quarter")},
            **calendar.edge_flags(d),
        })
    )


def pivot_weekday_month(df: DataFrame, spec: FactSpec = DEFAULT, how: str = "sum") -> DataFrame:
    """Weekday by month matrix of sums, or of means per record."""
    d = F.col(spec.date)
    agg = F.sum(spec.total) if how == "sum" else F.avg(spec.total)
    cells = (
        df.groupBy(calendar.day_of_week(d).alias("day_of_week"), F.month(d).alias("_m"))
        .agg(agg.alias("v"))
        .groupBy("day_of_week")
        .pivot("_m", list(range(1, 13)))
        .agg(F.first("v"))
    )
    return weekday_frame(df).join(cells, "day_of_week", "left").select(
        "day_of_week", "day_name",
        *[F.col(str(i)).alias(m) for i, m in enumerate(calendar.MONTHS, 1)],
    )


def peak_cell(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """The weekday and month with the largest sum."""
    d = F.col(spec.date)
    cells = total_by(
        present(df, spec.date), [calendar.day_of_week(d).alias("day_of_week"), F.month(d).alias("month")],
        spec.total, "value",
    )
    return cells.orderBy(F.desc("value"), "day_of_week", "month").limit(1)


def pivot_state_month(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 15) -> DataFrame:
    """State by month sums of the ``n`` largest states, largest first.

    Built from one grouped pass: the row total picks the states.
    """
    cells = total_by(present(df, spec.state, spec.date), [spec.state, F.month(spec.date).alias("_m")], spec.total, "v")
    months = list(range(1, 13))
    wide = cells.groupBy(spec.state).pivot("_m", months).agg(F.sum("v"))
    row_total = sum((F.coalesce(F.col(str(m)), F.lit(0)) for m in months[1:]),
                    F.coalesce(F.col("1"), F.lit(0)))
    return (
        wide.select(
            spec.state,
            *[F.col(str(i)).alias(m) for i, m in enumerate(calendar.MONTHS, 1)],
            row_total.alias("row_total"),
        )
        .orderBy(F.desc("row_total"), spec.state)
        .limit(n)
    )


def hierarchy_rollup(
    df: DataFrame, spec: FactSpec = DEFAULT, state: str | None = None
) -> DataFrame:
    """Tree of sums with subtotals, over all rows.

    Without a state the tree is state > district; with one it is
    state > district > pincode.
    """
    path = [spec.state, spec.district]
    rows = df
    if state is not None:
        path.append(spec.pincode)
        rows = df.where(F.col(spec.state) == state)
    totals = total_by(present(rows, *path), path, spec.total)
    depth = F.lit(len(path)) - sum((F.grouping(c) for c in path[1:]), F.grouping(path[0]))
    return totals.rollup(*path).agg(
        F.sum(spec.total).alias(spec.total), depth.cast("int").alias("depth")
    )


def quantile_linear(df: DataFrame, column: str, probs: dict[str, float]) -> DataFrame:
    """Linear quantiles of an aggregated set (days, districts) in one row."""
    return df.agg(*[F.percentile(column, F.lit(p)).alias(n) for n, p in probs.items()])


def first_max(key: str, value: str) -> Column:
    """Aggregate: the key of the largest value, first in key order on ties."""
    return F.min_by(key, F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))


def first_min(key: str, value: str) -> Column:
    """Aggregate: the key of the smallest value, first in key order on ties."""
    return F.min_by(key, F.struct(F.col(value).alias("v"), F.col(key).alias("k")))


def argmax_argmin(df: DataFrame, value: str, key: str) -> DataFrame:
    """Keys and values of the maximum and the minimum, in one aggregate."""
    return df.agg(
        first_max(key, value).alias("max_key"), F.max(value).alias("max_value"),
        first_min(key, value).alias("min_key"), F.min(value).alias("min_value"),
    )


def daily_stats(daily: DataFrame) -> DataFrame:
    """Mean, median, max, min and deviation of the daily series."""
    return daily.agg(
        F.avg("value").alias("mean"), F.median("value").alias("median"),
        F.max("value").alias("max"), F.min("value").alias("min"),
        F.stddev_samp("value").alias("std"),
    )


def with_ranks(totals: DataFrame, value: str) -> DataFrame:
    """Number a set of state totals upwards (``up``) and downwards (``down``)."""
    return totals.withColumns({
        "up": F.row_number().over(W.orderBy(F.asc(value))),
        "down": F.row_number().over(W.orderBy(F.desc(value))),
    })


def gini_column(value: str) -> Column:
    """Aggregate over ``with_ranks`` rows: the Gini coefficient."""
    n, s = F.count("*"), F.sum(value)
    weighted = 2.0 * F.sum(F.col("up") * F.col(value))
    return F.try_divide(weighted - (n + 1) * s, (n * s).cast("double"))


def share_of_top(value: str, k: int) -> Column:
    """Aggregate over ``with_ranks`` rows: percent of the sum in the top ``k``."""
    return numeric.percent(F.sum(F.when(F.col("down") <= k, F.col(value))), F.sum(value))


def gini(totals: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of any number of totals: equal ones share their ranks, which running counts of values give."""
    counts = totals.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("rows"))
    upto = quantile.cumulate(quantile.bucketed(counts), ())
    rows, last, v = F.col("rows"), F.col("upto"), F.col("value")
    n, s = F.sum(rows), F.sum(v * rows)
    weighted = F.sum((v * rows * (2 * last - rows + 1)).cast("double"))  # twice the values times their ranks
    return upto.agg(F.try_divide(weighted - (n + 1) * s, (n * s).cast("double")).alias("gini"))


def top_share(totals: DataFrame, value: str, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Share of the total held by the top ``k``, per ``k``, of any number of totals."""
    largest = totals.select(value).orderBy(F.desc_nulls_last(value)).limit(max(ks))
    downwards = largest.withColumn("down", F.row_number().over(W.orderBy(F.desc_nulls_last(value))))  # max(ks) rows
    every = totals.agg(F.sum(value)).scalar()
    return downwards.agg(*[F.sum(F.when(F.col("down") <= k, F.col(value))).alias(f"_{k}") for k in ks]).select(
        *[numeric.percent(F.col(f"_{k}"), every).alias(f"top_{k}_share") for k in ks]
    )
