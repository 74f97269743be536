"""Profiling and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import SQUARE, square, stddev_from_sums
from ..sources.scratch import pinned
from ..spec import DEFAULT, FactSpec
from .joins import attach
from .quantile import cumulate, histogram, quantile_columns
from .rows import seeded_hash

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per column, in one pass."""
    columns = list(columns or df.columns)
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(c).isNull()).alias("missing"),
            F.round(F.try_divide(F.count_if(F.col(c).isNull()), F.count("*")) * 100, 2).alias(
                "missing_pct"
            ),
        )
        for c in columns
    ]
    return df.agg(F.array(*entries).alias("s")).select(F.inline("s"))


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy of each distinct row, and their percentage."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    extra = F.sum("n") - F.count("*")
    return copies.agg(
        F.coalesce(extra, F.lit(0)).alias("duplicates"),
        F.round(F.try_divide(extra, F.sum("n")) * 100, 2).alias("duplicate_pct"),
    )


def shape_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, and the table's shape."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"))
        for i, (c, t) in enumerate(df.dtypes, 1)
    ]
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.inline(F.array(*entries))
    )


def _ranked(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return cumulate(histogram(df, columns, by), [*by, "measure"])


def describe_numeric(
    df: DataFrame, spec: FactSpec = DEFAULT, columns: Sequence[str] | None = None
) -> DataFrame:
    """count, mean, std, min, quartiles and max per measure, to 2 decimals.

    One scan feeds a value histogram; every statistic follows from it. The deviation of
    whole numbers comes from exact sums, that of fractions from distances to the mean.
    """
    ranked = _ranked(df, columns or spec.measures, ())
    v, rows = F.col("value"), F.col("rows")
    n, total = F.sum(rows), F.sum(v * rows)
    if isinstance(ranked.schema["value"].dataType, T.IntegralType):
        deviation = stddev_from_sums(n, total, F.sum((square(v) * rows).cast(SQUARE)))
    else:
        means = ranked.groupBy("measure").agg((total / n).cast("double").alias("centre"))
        ranked = ranked.join(means, "measure")
        apart = v.cast("double") - F.col("centre")
        deviation = F.when(n > 1, F.sqrt(F.sum(apart * apart * rows) / (n - 1)))
    return (
        ranked.groupBy("measure")
        .agg(
            n.alias("count"),
            F.round(total / n, 2).alias("mean"),
            F.round(deviation, 2).alias("std"),
            F.min(v).alias("min"),
            *quantile_columns(QUARTILES),
            F.max(v).alias("max"),
        )
        .withColumns({q: F.round(q, 2) for q in QUARTILES})
    )


def coverage_summary(
    df: DataFrame, spec: FactSpec = DEFAULT, pincodes: DataFrame | None = None
) -> DataFrame:
    """Date range, distinct places, record count and totals in one row.

    With ``df`` a day cube, ``pincodes`` supplies the pincodes.
    """
    summary = df.agg(
        F.min(spec.date).alias("first_date"),
        F.max(spec.date).alias("last_date"),
        F.count_distinct(spec.state).alias("states"),
        F.count_distinct(spec.district).alias("districts"),
        (F.count("*") if pincodes is None else F.sum("records")).alias("records"),
        *([F.count_distinct(spec.pincode).alias("pincodes")] if pincodes is None else []),
        *[F.sum(c).alias(f"sum_{c}") for c in spec.measures],
    )
    if pincodes is None:
        return summary
    return attach(summary, pincodes.agg(F.count_distinct(spec.pincode).alias("pincodes")))


def equal_width_histogram(
    df: DataFrame, spec: FactSpec = DEFAULT, bins: int = 50, columns: Sequence[str] | None = None
) -> DataFrame:
    """Equal-width bins between min and max, empty ones kept, with mean and median.

    A constant column gets a range of one around its value.
    """
    v, rows = F.col("value"), F.col("rows")
    ranked = _ranked(df, columns or spec.measures, ())
    flat = F.min(v) == F.max(v)
    low = F.when(flat, F.min(v) - 0.5).otherwise(F.min(v).cast("double"))
    high = F.when(flat, F.max(v) + 0.5).otherwise(F.max(v).cast("double"))
    limits = ranked.groupBy("measure").agg(
        low.alias("lo"),
        high.alias("hi"),
        (F.sum(v * rows) / F.sum(rows)).alias("mean"),
        *quantile_columns({"median": 0.5}),
    )
    place = F.floor((v - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1
    counts = (
        ranked.select("measure", "value", "rows")
        .join(limits, "measure")
        .groupBy("measure", F.least(place, F.lit(bins)).cast("int").alias("bin"))
        .agg(F.sum("rows").alias("rows"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        limits.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
        .join(counts, ["measure", "bin"], "left")
        .select(
            "measure", "bin",
            (F.col("lo") + width * (F.col("bin") - 1)).alias("lower"),
            (F.col("lo") + width * F.col("bin")).alias("upper"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            "mean", "median",
        )
    )


def boxplot_stats(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    reach: float = 1.5,
) -> DataFrame:
    """Box plot numbers: quartiles, whiskers, outlier count and median notch.

    Whiskers end at the last value within ``reach`` times the quartile range.
    """
    return _boxes(histogram(df, columns or spec.parts, by), [*by, "measure"], reach)


def _boxes(hist: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    v, rows = F.col("value"), F.col("rows")
    ranked = cumulate(hist, keys)
    boxes = ranked.groupBy(*keys).agg(
        F.max("n").alias("count"), *quantile_columns({"q1": 0.25, "median": 0.5, "q3": 0.75})
    )
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - reach * iqr, F.col("q3") + reach * iqr
    notch = F.lit(1.57) * iqr / F.sqrt(F.col("count").cast("double"))
    box = ["count", "q1", "median", "q3"]
    whisker_low = F.least(F.min(F.when(v >= low, v)).cast("double"), F.col("q1"))
    whisker_high = F.greatest(F.max(F.when(v <= high, v)).cast("double"), F.col("q3"))
    return (
        ranked.select(*keys, "value", "rows")
        .join(boxes, keys)
        .groupBy(*keys, *box)
        .agg(
            whisker_low.alias("whisker_low"),
            whisker_high.alias("whisker_high"),
            F.coalesce(F.sum(F.when((v < low) | (v > high), rows)), F.lit(0)).alias("outliers"),
        )
        .withColumns({"notch_low": F.col("median") - notch, "notch_high": F.col("median") + notch})
    )


def boxplot_by_state(df: DataFrame, spec: FactSpec = DEFAULT, n: int = 10) -> DataFrame:
    """Box plots of the total per record in the ``n`` largest states, by median.

    The value histogram also holds the state totals, so the largest states are
    found without another pass over the records. It is pinned for its uses.
    """
    hist = pinned(histogram(df, [spec.total], [spec.state]), "histogram")
    totals = hist.groupBy(spec.state).agg(F.sum(F.col("value") * F.col("rows")).alias("t"))
    top = totals.orderBy(F.desc("t"), spec.state).limit(n).select(spec.state)
    chosen = hist.join(top, spec.state)
    boxes = _boxes(chosen, [spec.state, "measure"], 1.5)
    return boxes.drop("measure").orderBy(F.desc("median"), spec.state)


def _pearson(a: str, b: str) -> Column:
    """Correlation, null for a constant column (``corr`` divides by zero there)."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), spread)


def correlation_matrix(
    df: DataFrame,
    spec: FactSpec = DEFAULT,
    columns: Sequence[str] | None = None,
    lower_triangle: bool = False,
) -> DataFrame:
    """Pearson correlation of every pair of measures, in one aggregate."""
    columns = list(columns or spec.measures)
    cells = [
        F.struct(F.lit(a).alias("measure_a"), F.lit(b).alias("measure_b"), _pearson(a, b).alias("r"))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if j < i or not lower_triangle
    ]
    return df.agg(F.array(*cells).alias("s")).select(F.inline("s"))


def pairwise_correlation(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Correlation of each pair of parts."""
    return correlation_matrix(df, spec, spec.parts, lower_triangle=True)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """A fixed random sample of ``n`` rows: the least hashes of the key columns."""
    return df.orderBy(seeded_hash(seed, *keys), *keys).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per category, most frequent first; nulls are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
    )
