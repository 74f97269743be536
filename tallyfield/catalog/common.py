"""What the registered queries share: table loaders and output rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregate, joins
from ..sources import tables

A = tables.ACTIVITY
Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict):
    """Query name to callable, filled by decoration."""

    def add(self, name: str, digits: int = 6) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self:
                raise ValueError(f"query {name} is registered twice")
            self[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
            return fn

        return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round double columns so that summation order cannot show."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.activity(spark, sf_dir)


def lines(spark: SparkSession, sf_dir: str, *dims: str) -> DataFrame:
    return tables.activity_lines(spark, sf_dir, dims or ("date",))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.daily_total(lines(spark, sf_dir), A)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.monthly_total(lines(spark, sf_dir), A)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.state_total(lines(spark, sf_dir, "state"), A)


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.district_total(lines(spark, sf_dir, "state", "district"), A)


def fixed_holidays(spark: SparkSession) -> DataFrame:
    """Christmas and New Year, for the years the order tables can span."""
    return joins.holiday_calendar(spark, {
        f"{year}-{day}": name
        for year in range(1990, 2011)
        for day, name in (("01-01", "New Year"), ("12-25", "Christmas"))
    })
