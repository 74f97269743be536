"""Lookups, semi and anti joins, and neighbouring days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The default holiday calendar.
HOLIDAYS_2025 = {
    "2025-01-14": "Makar Sankranti",
    "2025-01-26": "Republic Day",
    "2025-03-14": "Holi",
    "2025-04-14": "Ambedkar Jayanti",
    "2025-04-18": "Good Friday",
    "2025-05-12": "Buddha Purnima",
    "2025-08-15": "Independence Day",
    "2025-08-16": "Janmashtami",
    "2025-10-02": "Gandhi Jayanti",
    "2025-10-20": "Dussehra",
    "2025-11-01": "Diwali",
    "2025-11-05": "Bhai Dooj",
    "2025-12-25": "Christmas",
}


def holiday_calendar(
    spark: SparkSession, holidays: Mapping[str, str] = HOLIDAYS_2025
) -> DataFrame:
    """A calendar as (date, holiday) rows."""
    rows = F.array(*[
        F.struct(F.lit(d).cast("date").alias("date"), F.lit(n).alias("holiday"))
        for d, n in holidays.items()
    ])
    return spark.range(1).select(F.inline(rows))


def lookup_weekday_mean(
    daily: DataFrame, value: str = "value", out: str = "weekday_mean", by: Sequence[str] = ()
) -> DataFrame:
    """Attach to each day the mean of its weekday."""
    same_day = W.partitionBy(*by, F.weekday("date"))
    return daily.withColumn(out, F.avg(value).over(same_day))


def holiday_lookup(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    """The days that are holidays, with their names."""
    return daily.join(holidays, "date")


def holiday_anti(daily: DataFrame, holidays: DataFrame) -> DataFrame:
    """The days that are not holidays."""
    return daily.join(holidays, "date", "left_anti")


def interval_neighbors(daily: DataFrame, anchors: DataFrame, days: int = 3) -> DataFrame:
    """Pair each anchor date with the days around it: (anchor, offset, date, value).

    The interval condition is spelled out as its few possible offsets, which
    turns the range join into a hash join on the date.
    """
    offsets = F.array(*[F.lit(o) for o in range(-days, days + 1) if o])
    near = anchors.select(F.col("date").alias("anchor"), F.explode(offsets).alias("offset"))
    near = near.withColumn("date", F.date_add("anchor", F.col("offset")))
    return near.join(daily, "date").select("anchor", "offset", "date", "value")


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row, as one scalar subquery."""
    row = one_row.select(F.struct(*one_row.columns).alias("row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def with_scalars(df: DataFrame, stats: Mapping[str, Column]) -> DataFrame:
    """Attach set-level statistics (mean, deviation, quantile) to every row."""
    return attach(df, df.agg(*[c.alias(n) for n, c in stats.items()]))


def name_lookup(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Attach names by key; rows without a name keep null."""
    return df.join(names, key, "left")


def reindex(
    df: DataFrame, key: str, values: Sequence[str], fill: Mapping[str, float] | None = None
) -> DataFrame:
    """Align to a fixed list of key values, in that order; absent ones stay as null."""
    listed = F.posexplode(F.array(*[F.lit(v) for v in values])).alias("position", key)
    aligned = df.sparkSession.range(1).select(listed).join(df, key, "left")
    return aligned.fillna(dict(fill)) if fill else aligned
