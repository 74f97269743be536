"""Holt's recurrence over series of any length.

A step takes the state s = (level, trend) to A s + k y, with A and k set by the two factors alone. So a stretch of a
series takes s to M s + c, whatever s is: stretches of bounded length, a year of dates or ``STRETCH`` numbers, are folded
side by side, and a series is then a fold over its stretches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of a numbered series in a stretch.
STRETCH = 4096

_STATE = "struct<level:double,trend:double>"
_MAP = "struct<m0:double,m1:double,m2:double,m3:double,c0:double,c1:double>"


def _stretch(place: Column, kind: T.DataType) -> Column:
    """A number that all places of a stretch share."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(place)
    return F.floor(place / STRETCH)


def _fold(values: Column, alpha: float, beta: float) -> Column:
    """M and c of the steps over an array of values."""
    a, b, c, d = 1 - alpha, 1 - alpha, -alpha * beta, 1 - alpha * beta

    def step(s: Column, y: Column) -> Column:
        return F.struct(
            (a * s["m0"] + b * s["m2"]).alias("m0"), (a * s["m1"] + b * s["m3"]).alias("m1"),
            (c * s["m0"] + d * s["m2"]).alias("m2"), (c * s["m1"] + d * s["m3"]).alias("m3"),
            (a * s["c0"] + b * s["c1"] + alpha * y).alias("c0"), (c * s["c0"] + d * s["c1"] + alpha * beta * y).alias("c1"),
        ).cast(_MAP)

    unit = F.struct(*[F.lit(x).alias(n) for n, x in zip(("m0", "m1", "m2", "m3", "c0", "c1"), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))]).cast(_MAP)
    return F.aggregate(values, unit, step)


def smoothed(df: DataFrame, order: str, value: str, alpha: float, beta: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, last, level, trend): the state after the last row of each series, and that row's place.

    It begins with the first value and the difference of the first two, 0 with one value alone. A missing value makes the
    state null from there on; an empty table has no series. Places are dates, timestamps or numbers, one row each.
    """
    by, kind = list(by), df.schema[order].dataType
    rows = df.select(*by, _stretch(F.col(order), kind).alias("_stretch"), F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("y")).alias("_row"))
    held = rows.groupBy(*by, "_stretch").agg(F.array_sort(F.collect_list("_row")).alias("r"))
    rest = F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: x["y"])
    part = F.struct(
        F.element_at("r", 1)["at"].alias("first"), F.element_at("r", -1)["at"].alias("last"), F.element_at("r", 1)["y"].alias("y0"),
        F.try_element_at("r", F.lit(2))["y"].alias("y1"), (F.size("r") > 1).alias("more"), _fold(rest, alpha, beta).alias("m"),
    )
    each = held.select(*by, part.alias("part")).groupBy(*by).agg(F.array_sort(F.collect_list("part")).alias("parts")).where(F.size("parts") > 0)

    def through(s: Column, p: Column) -> Column:
        m = p["m"]
        level = m["m0"] * s["level"] + m["m1"] * s["trend"] + m["c0"]
        trend = m["m2"] * s["level"] + m["m3"] * s["trend"] + m["c1"]
        return F.struct(level.alias("level"), trend.alias("trend")).cast(_STATE)

    def further(s: Column, p: Column) -> Column:
        level = alpha * p["y0"] + (1 - alpha) * (s["level"] + s["trend"])
        trend = beta * (level - s["level"]) + (1 - beta) * s["trend"]
        return through(F.struct(level.alias("level"), trend.alias("trend")).cast(_STATE), p)

    first = F.element_at("parts", 1)
    second = F.when(first["more"], first["y1"]).when(F.size("parts") > 1, F.try_element_at("parts", F.lit(2))["y0"]).otherwise(first["y0"])
    start = through(F.struct(first["y0"].alias("level"), (second - first["y0"]).alias("trend")).cast(_STATE), first)
    s = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), start, further)
    return each.select(*by, F.element_at("parts", -1)["last"].alias("last"), s.alias("s")).select(*by, "last", "s.level", "s.trend")
