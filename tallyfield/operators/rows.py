"""Row filters shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null.

    Spelled with plain ``IS NOT NULL``: a later join on such a column infers
    the same filter, so both uses of one aggregate keep one plan and share its
    shuffle. ``dropna`` is a different expression and would split them.
    """
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))


def seeded_hash(seed: int, *keys: str) -> Column:
    """A hash of the keys as text that other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
