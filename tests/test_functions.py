"""Scalar functions on the awkward inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import calendar, numeric, text


def apply(spark, values, fn, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_title_case_starts_words_after_any_non_letter(spark):
    names = ["o'brien", "north-east", "y.s.r. kadapa", "2nd zone", "UPPER case"]
    assert apply(spark, names, text.title_case) == [
        "O'Brien", "North-East", "Y.S.R. Kadapa", "2Nd Zone", "Upper Case"
    ]


def test_normalize_text_tests_tokens_before_symbols(spark):
    names = ["  west bengal* ", "nan", "NONE", "", " None ", "*", None]
    assert apply(spark, names, text.normalize_text) == ["West Bengal", None, None, None, None, "", None]
    strict = apply(spark, names, lambda c: text.normalize_text(c, strict=True))
    assert strict[5] is None


def test_valid_pincode(spark):
    assert apply(spark, ["110001", " 110001 ", "11000", "110001.0", None], text.valid_pincode) == [
        "110001", "110001", None, None, None
    ]


def test_parse_day_first(spark):
    texts = ["1-3-2025", "01-03-2025", "31-02-2025", "2025-03-01", "01-03-25", "1/3/2025"]
    day = dt.date(2025, 3, 1)
    assert apply(spark, texts, calendar.parse_day_first) == [day, day, None, None, None, None]


def test_coerce_count(spark):
    texts = ["3.7", "-2", "abc", "1e3", " 12 ", "5d", "NaN", "Infinity", "", None, "1e30"]
    assert apply(spark, texts, numeric.coerce_count) == [3, 0, 0, 1000, 12, 0, 0, 0, 0, 0, 0]


def test_format_indian(spark):
    values = [999.0, 1000.0, 150000.0, 25000000.0]
    assert apply(spark, values, text.format_indian, "double") == ["999", "1.0K", "1.5L", "2.5Cr"]
    wide = apply(spark, values, lambda c: text.format_indian(c, 2, spaced=True), "double")
    assert wide == ["999", "1.00 K", "1.50 L", "2.50 Cr"]


def test_milestone_label(spark):
    assert apply(spark, [25_000_000, 500_000], text.milestone_label, "bigint") == ["25M", "500K"]


def test_calendar_columns(spark):
    day = dt.date(2024, 12, 30)
    df = spark.createDataFrame([(day,)], "d date").select(
        *[c.alias(n) for n, c in calendar.calendar_columns(F.col("d")).items()]
    )
    assert tuple(df.first()) == (2024, 12, 30, 0, "Monday", "December", 4, 1)


def test_undefined_ratios(spark):
    df = spark.createDataFrame([(5, 0), (5, 10)], "a bigint, b bigint")
    got = df.select(
        numeric.percent(F.col("a"), F.col("b")), numeric.share(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(r) for r in got] == [(None, 0.0), (50.0, 50.0)]


def test_cap_keeps_null(spark):
    assert apply(spark, [None, 2.0, 0.5], lambda c: numeric.cap(c, F.lit(1.0)), "double") == [None, 1.0, 0.5]
    assert apply(spark, [None, -2.0, 0.5], numeric.clip_lower, "double") == [0.0, 0.0, 0.5]


def test_stddev_from_sums_is_exact(spark):
    df = spark.createDataFrame([(1_000_000_000 + i,) for i in (1, 2, 3, 4)], "v bigint")
    got = df.agg(
        numeric.stddev_from_sums(F.count("v"), F.sum("v"), F.sum(F.col("v") * F.col("v"))).alias("s")
    ).first().s
    assert got == pytest.approx((5 / 3) ** 0.5, rel=1e-12)
