"""Exact order statistics that never sort a whole table in one task.

The rows are first reduced to (value, number of rows) pairs. Values fall into
buckets of equal relative width, 256 to each doubling; a bucket crowded with
distinct values is cut into parts of equal width between its own least and
largest value. So running counts need only two bounded sorts: one over the part
totals, one inside every part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import present

_STEPS = 256
#: Above the exponents of all doubles, so that bucket numbers of positive values are positive.
_OFFSET = 1100 * _STEPS
#: Distinct values that a part of a bucket holds on average.
CROWD = 4096


def bucket(value: Column) -> Column:
    """A coarse, order-preserving bucket of a number, whatever its magnitude; NaN counts as missing."""
    v = F.nullif(value.cast("double"), F.lit(float("nan")))
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1024.0)) * _STEPS) + _OFFSET
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("int")


def part(value: Column, low: Column, high: Column, values: Column) -> Column:
    """The order-preserving part of a bucket of so many distinct values between ``low`` and ``high``."""
    parts = F.ceil(values / CROWD)
    v, a, b = (c.cast("double") for c in (value, low, high))
    return F.when(parts <= 1, F.lit(0)).otherwise(
        F.least(F.floor(F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0)) * parts), parts - 1)
    ).cast("int")


def bucketed(counts: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Add the bucket of each value; null values and groups drop out.

    The filters, here and on the rows, name what later joins would infer, so
    all uses of the counts keep one plan and share its shuffle.
    """
    return present(counts.withColumn("bucket", bucket(F.col(value))), *by, "bucket")


def histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value of each column: (``by``, measure, value, rows, bucket).

    Equal rows collapse before columns are laid out one under the other, and
    partial aggregation does so ahead of the shuffle. The shuffle key holds the
    values, so one large group is still spread out.
    """
    rows = present(df, *by) if by else df
    distinct = rows.groupBy(*by, *columns).agg(F.count("*").alias("rows"))
    if len(columns) == 1:
        counts = distinct.select(
            *by, F.lit(columns[0]).alias("measure"), F.col(columns[0]).alias("value"), "rows"
        )
    else:
        long = distinct.unpivot([*by, "rows"], list(columns), "measure", "value")
        counts = long.groupBy(*by, "measure", "value").agg(F.sum("rows").alias("rows"))
    return bucketed(counts, by)


def cumulate(hist: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Add ``upto`` (rows at or below the value) and ``n`` (rows of the group)."""
    group = W.partitionBy(*by)
    running = group.orderBy("bucket", "part").rowsBetween(W.unboundedPreceding, -1)
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    crowds = hist.groupBy(*by, "bucket").agg(
        F.count("*").alias("_values"), F.min(value).alias("_low"), F.max(value).alias("_high")
    )
    hist = hist.join(crowds, [*by, "bucket"]).withColumn(
        "part", part(F.col(value), F.col("_low"), F.col("_high"), F.col("_values"))
    ).drop("_low", "_high", "_values")
    coarse = (
        hist.groupBy(*by, "bucket", "part")
        .agg(F.sum("rows").alias("in_bucket"))
        .select(
            *by, "bucket", "part",
            F.coalesce(F.sum("in_bucket").over(running), F.lit(0)).alias("before"),
            F.sum("in_bucket").over(whole).alias("n"),
        )
    )
    inside = W.partitionBy(*by, "bucket", "part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (
        hist.join(coarse, [*by, "bucket", "part"])
        .withColumn("upto", F.col("before") + F.sum("rows").over(inside))
        .drop("before", "bucket", "part")
    )


def quantile_columns(probs: dict[str, float], value: str = "value") -> list[Column]:
    """Aggregates over a cumulated histogram giving linear quantiles.

    The order statistic at 0-based position ``k`` is the least value with more
    than ``k`` rows at or below it.
    """
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("upto") > F.ceil(at), F.col(value)))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return out


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles of columns per group."""
    keys = [*by, "measure"]
    ranked = cumulate(histogram(df, columns, by), keys)
    return ranked.groupBy(*keys).agg(*quantile_columns(probs))


def average_rank_percent(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percentile rank (mean rank of equal values over the row count, times 100).

    Ranks are worked out per distinct value and joined back by value.
    """
    counts = df.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("rows"))
    hist = bucketed(counts, (), "_value")
    mean_rank = F.col("upto") - (F.col("rows") - 1) / 2
    ranks = cumulate(hist, (), "_value").select("_value", (mean_rank / F.col("n") * 100).alias(out))
    return df.join(ranks, F.col(value) == F.col("_value"), "left").drop("_value")
