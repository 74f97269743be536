"""Null-safe arithmetic on counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE, SQUARE = "decimal(19,0)", "decimal(38,0)"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null when undefined."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, null when undefined."""
    return ratio(part, whole) * 100.0


def share(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, zero when undefined."""
    return F.coalesce(percent(part, whole), F.lit(0.0))


def clip_lower(c: Column, bound: float = 0.0) -> Column:
    """The larger of the bound and the value; null counts as the bound."""
    return F.greatest(F.lit(float(bound)), c)


def cap(c: Column, upper: Column) -> Column:
    """Clip the upper tail; a null stays null (``least`` would skip it)."""
    return F.when(c.isNotNull(), F.least(c, upper))


def parse_number(c: Column) -> Column:
    """Numeric text as a double; anything that is not a plain number is null."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def coerce_count(c: Column) -> Column:
    """A whole, non-negative count: bad and negative values become 0.

    Short runs of digits, which is nearly all there is, skip the pattern.
    """
    plain = (F.translate(c, "0123456789", "") == "") & F.length(c).between(1, 18)
    number = parse_number(c)
    other = F.when(number >= 0, number).try_cast("bigint")
    return F.coalesce(F.when(plain, c.try_cast("bigint")).otherwise(other), F.lit(0).cast("bigint"))


def square(c: Column) -> Column:
    """The exact square of a whole number; its sums have 38 digits."""
    return (c.cast(WHOLE) * c.cast(WHOLE)).cast(SQUARE)


def stddev_from_sums(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from exact integer sums.

    ``total`` is whole, ``squares`` a sum of ``square``. Integer sums do not depend on the order in which partial results meet, so
    a recomputed task yields bit for bit the same value; they also roll up
    from a finer grain. Null for fewer than two rows.
    """
    count = F.nullif(n, F.lit(0))
    middle = F.call_function("div", total, count)
    rest = (total - middle * count).cast("double")
    # around the whole number next to the mean nothing grows beyond the squares themselves
    around = squares - (middle.cast(WHOLE) * (total + total - middle * count).cast(WHOLE)).cast(SQUARE)
    spread = around.cast("double") - rest * rest / count.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (count.cast("double") - 1.0)))
