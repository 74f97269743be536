"""Cleaning of raw text rows into the typed fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar, numeric, text
from ..spec import DEFAULT, FactSpec
from .ranking import ranked
from .rows import present


def parse_date(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Day-first text to a date; unreadable text becomes null."""
    return df.withColumn(spec.date, calendar.parse_day_first(F.col(spec.date)))


def invalid_date_count(parsed: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Number of rows whose date could not be read."""
    return parsed.agg(F.count_if(F.col(spec.date).isNull()).alias("invalid_dates"))


def add_calendar(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    return df.withColumns(calendar.calendar_columns(F.col(spec.date)))


def add_edge_flags(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    return df.withColumns(calendar.edge_flags(F.col(spec.date)))


def normalize_names(df: DataFrame, spec: FactSpec = DEFAULT, strict: bool = False) -> DataFrame:
    """Standardise state and district names."""
    names = (spec.state, spec.district)
    return df.withColumns({c: text.normalize_text(F.col(c), strict) for c in names})


def validate_pincode(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Keep six-digit pincodes, null the rest."""
    return df.withColumn(spec.pincode, text.valid_pincode(F.col(spec.pincode)))


def pincode_report(raw: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Invalid rows and distinct valid pincodes of a raw table."""
    valid = text.valid_pincode(F.col(spec.pincode))
    return raw.select(valid.alias("p")).agg(
        F.count_if(F.col("p").isNull()).alias("invalid_pincodes"),
        F.count_distinct("p").alias("unique_valid_pincodes"),
    )


def coerce_counts(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Counts as non-negative whole numbers; bad and negative values become 0."""
    return df.withColumns({c: numeric.coerce_count(F.col(c)) for c in spec.parts})


def counts_report(raw: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Per count column: negative values seen, then min, max and mean once cleaned."""
    stats = []
    for c in spec.parts:
        clean = numeric.coerce_count(F.col(c))
        stats.append(
            F.struct(
                F.lit(c).alias("measure"),
                F.count_if(numeric.parse_number(F.col(c)) < 0).alias("negatives"),
                F.min(clean).alias("min"),
                F.max(clean).alias("max"),
                F.avg(clean).alias("mean"),
            )
        )
    return raw.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def add_row_total(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    a, b, c = (F.col(p) for p in spec.parts)
    return df.withColumn(spec.total, a + b + c)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of rows equal in all columns (nulls are equal)."""
    return df.dropDuplicates()


def drop_missing_critical(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Drop rows without a date, state or district."""
    return present(df, spec.date, spec.state, spec.district)


def drop_numeric_names(df: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Drop rows whose state or district is missing or only a number."""
    keep = F.lit(True)
    for c in (F.col(spec.state), F.col(spec.district)):
        keep = keep & c.isNotNull() & ~text.is_numeric_name(c)
    return df.where(keep)


def clean_rows(raw: DataFrame, spec: FactSpec = DEFAULT, strict: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """The raw columns cleaned row by row, rows without critical values left out; ``also`` names columns that are carried along."""
    named = ~text.is_missing_name(F.col(spec.state), strict)
    named = named & ~text.is_missing_name(F.col(spec.district), strict)
    return (
        raw.select(*spec.raw_columns, *also)
        .where(named)
        .transform(parse_date, spec)
        .transform(present, spec.date)
        .transform(normalize_names, spec, strict)
        .transform(validate_pincode, spec)
        .transform(coerce_counts, spec)
    )


def derived(rows: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Cleaned rows with their calendar and total."""
    return rows.transform(add_calendar, spec).transform(add_row_total, spec)


def clean(raw: DataFrame, spec: FactSpec = DEFAULT, strict: bool = False) -> DataFrame:
    """The whole cleaning pipeline.

    Everything but the duplicate removal is one row-local projection. Rows
    without critical values go first, on the raw text: duplicates agree on
    those columns, so the result is the same, and no name is rewritten twice
    (a filter on rewritten names would be pushed below the rewriting).
    Calendar columns follow from the date, so they are added after the shuffle
    instead of travelling through it.
    """
    return derived(drop_exact_duplicates(clean_rows(raw, spec, strict)), spec)


def add_shares(df: DataFrame, spec: FactSpec = DEFAULT, keep_null: bool = False) -> DataFrame:
    """Percentage of each part in the total: 0, or null, when undefined."""
    fn = numeric.percent if keep_null else numeric.share
    total = F.col(spec.total)
    return df.withColumns(
        {name: fn(F.col(p), total) for name, p in zip(spec.share_names, spec.parts)}
    )


def label_encode(
    df: DataFrame, column: str, out: str | None = None, missing: str = "Unknown"
) -> DataFrame:
    """Integer codes of a label column in sorted order; null counts as a label.

    The codes come from the distinct labels, numbered by ranges and joined back by label, so neither rows
    nor labels pass through one task.
    """
    out = out or f"{column}_encoded"
    labelled = df.withColumn("_label", F.coalesce(F.col(column), F.lit(missing)))
    codes = ranked(labelled.select("_label").distinct(), ["_label"], "_at").select("_label", (F.col("_at") - 1).cast("int").alias(out))
    return labelled.join(codes, "_label").drop("_label")


def fill_null(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.fillna(value, subset=list(columns))
