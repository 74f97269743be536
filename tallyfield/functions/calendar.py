"""Calendar columns and date text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar order of names.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)

# Report date layouts.
DATE_LAYOUTS = {
    "iso": "yyyy-MM-dd",
    "day_first": "dd-MM-yyyy",
    "short_month": "dd MMM yyyy",
    "month_year": "MMM yyyy",
}


def parse_day_first(c: Column) -> Column:
    """Parse ``d-m-yyyy`` text; anything else becomes null."""
    return F.try_to_date(c, "d-M-yyyy")


def day_of_week(d: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(d)


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def calendar_columns(d: Column) -> dict[str, Column]:
    """The eight calendar attributes of a date."""
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": day_of_week(d),
        "day_name": F.date_format(d, "EEEE"),
        "month_name": F.date_format(d, "MMMM"),
        "quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d),
    }


def edge_flags(d: Column) -> dict[str, Column]:
    """0/1 flags: weekend, first five days of the month, 26th and later."""
    return {
        "is_weekend": is_weekend(d).cast("int"),
        "is_month_start": (F.dayofmonth(d) <= 5).cast("int"),
        "is_month_end": (F.dayofmonth(d) >= 26).cast("int"),
    }


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def week_start(d: Column) -> Column:
    """The Monday of the week."""
    return F.trunc(d, "week")


def format_date(d: Column, layout: str = "iso") -> Column:
    return F.date_format(d, DATE_LAYOUTS[layout])
