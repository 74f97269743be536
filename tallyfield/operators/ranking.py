"""Positions and running totals over an order of any keys, without one task that sees all rows.

Rows are dealt by range of the order and written; each range then knows its rows and sums, a number a range comes to the
driver, and inside a range a window counts on from what lies before it. Ties in the order should be broken by a unique
key, as equal rows fall into one range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import pinned


def ranked(
    df: DataFrame, order: Sequence[str | Column], position: str = "position", running: Mapping[str, str] | None = None,
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """``df`` with its 1-based ``position`` in the order, running sums (name to column), and sums of all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    running, whole = dict(running or {}), dict(whole or {})
    ranges = pinned(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    columns = sorted({*running.values(), *whole.values()})
    sums = {c: f"_sum_{i}" for i, c in enumerate(columns)}
    found = ranges.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(s) for c, s in sums.items()]).collect()  # a row a range
    size = {r["_range"]: r for r in found}

    def before(name: str) -> Column:
        """What the ranges before hold, for each range."""
        out, total = [], None
        for k in range(max(size, default=-1) + 1):
            out.append(total)
            if k in size and size[k][name] is not None:
                total = size[k][name] if total is None else total + size[k][name]
        zero = 0 if total is None else total * 0
        return F.element_at(F.array(*[F.lit(zero if x is None else x) for x in out] or [F.lit(0)]), F.col("_range") + 1)

    own = W.partitionBy("_range").orderBy(*order)
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    made = {position: F.row_number().over(own) + before("_rows")}
    made |= {name: before(sums[c]) + F.coalesce(F.sum(c).over(upto), F.lit(0)) for name, c in running.items()}
    for name, c in whole.items():
        parts = [r[sums[c]] for r in found if r[sums[c]] is not None]
        made[name] = F.lit(sum(parts[1:], parts[0]) if parts else None)
    return ranges.withColumns(made).drop("_range")
