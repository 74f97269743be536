"""Filters, sorts and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import DEFAULT, FactSpec
from .aggregate import district_total, pincode_total, state_total
from .rows import present


def filter_date_range(
    df: DataFrame, start: str | date, end: str | date, spec: FactSpec = DEFAULT
) -> DataFrame:
    """Rows between two days, both included."""
    return df.where(
        F.col(spec.date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )


def filter_states(df: DataFrame, states: Sequence[str], spec: FactSpec = DEFAULT) -> DataFrame:
    """Rows of the chosen states; no choice means all."""
    return df.where(F.col(spec.state).isin(*states)) if states else df


def filter_value_range(
    df: DataFrame, low: float, high: float, spec: FactSpec = DEFAULT
) -> DataFrame:
    """Rows whose total lies between two bounds, both included."""
    return df.where(F.col(spec.total).between(low, high))


def filter_drill_state(df: DataFrame, state: str, spec: FactSpec = DEFAULT) -> DataFrame:
    return df.where(F.col(spec.state) == state)


def sort_recent_first(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Newest rows first; district and pincode break ties, so that one busy day can be split."""
    return df.orderBy(F.desc(spec.date), spec.district, spec.pincode)


def top_k(
    df: DataFrame, value: str, keys: Sequence[str], n: int, smallest: bool = False
) -> DataFrame:
    """The ``n`` rows with the largest value, first in key order on ties."""
    by = F.asc(value) if smallest else F.desc(value)
    return df.orderBy(by, *keys).limit(n)


def top_states(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 10) -> DataFrame:
    return top_k(state_total(present(df, spec.state), spec), spec.total, [spec.state], n)


def top_districts(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 10) -> DataFrame:
    keys = spec.geo_keys("district")
    return top_k(district_total(present(df, *keys), spec), spec.total, keys, n)


def bottom_districts(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 10) -> DataFrame:
    keys = spec.geo_keys("district")
    totals = district_total(present(df, *keys), spec)
    return top_k(totals, spec.total, keys, n, smallest=True)


def top_pincodes(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 20) -> DataFrame:
    return top_k(pincode_total(df, spec), spec.total, [spec.pincode], n)


def semi_top_states(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 10) -> DataFrame:
    """Rows of the ``n`` largest states."""
    top = top_states(df, spec, n).select(spec.state)
    return df.join(top, spec.state, "left_semi")


def top_with_others(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 10) -> DataFrame:
    """The ``n`` largest states and one row for the rest, with percentages."""
    totals = state_total(present(df, spec.state), spec)
    top = top_k(totals, spec.total, [spec.state], n).select(
        spec.state, F.lit(True).alias("kept")
    )
    name = F.when(F.col("kept"), F.col(spec.state)).otherwise("Others").alias(spec.state)
    named = (
        totals.join(top, spec.state, "left")
        .groupBy(name)
        .agg(F.sum(spec.total).alias(spec.total))
        .where((F.col(spec.state) != "Others") | (F.col(spec.total) > 0))
    )
    whole = named.agg(F.sum(spec.total)).scalar()
    return named.withColumn("pct", F.try_divide(F.col(spec.total) * 100.0, whole))


def filter_min_history(df: DataFrame, keys: Sequence[str], more_than: int) -> DataFrame:
    """Series with more than so many points, as (keys, points)."""
    return df.groupBy(*keys).agg(F.count("*").alias("points")).where(F.col("points") > more_than)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def date_bounds(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    return df.agg(F.min(spec.date).alias("first_date"), F.max(spec.date).alias("last_date"))
