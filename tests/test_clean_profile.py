import datetime as dt

from tallyfield.operators import clean as c
from tallyfield.operators import profile as p
from tallyfield.sources import files
from tallyfield.spec import DEFAULT as D

RAW = [
    ("01-03-2025", " uttar pradesh", "agra*", "282001", "3", "2", "1"),
    ("1-3-2025", "Uttar Pradesh", "Agra", "282001 ", "3.9", "2", "1"),
    ("31-02-2025", "Goa", "Panaji", "403001", "1", "1", "1"),
    ("02-03-2025", "None", "X", "403001", "1", "1", "1"),
    ("02-03-2025", "goa", "o'hara-park", "4030", "-4", "x", "7"),
]


def raw(spark):
    return spark.createDataFrame(RAW, files.raw_schema())


def test_clean_pipeline(spark):
    got = c.clean(raw(spark)).orderBy("date", "state").collect()
    assert len(got) == 2
    agra, goa = got
    assert (agra.date, agra.state, agra.district, agra.pincode) == (
        dt.date(2025, 3, 1), "Uttar Pradesh", "Agra", "282001"
    )
    assert (agra.age_0_5, agra.total_enrollments, agra.day_name, agra.week_of_year) == (3, 6, "Saturday", 9)
    assert (goa.district, goa.pincode, goa.age_0_5, goa.age_5_17, goa.total_enrollments) == (
        "O'Hara-Park", None, 0, 0, 7
    )


def test_clean_schema_is_the_declared_one(spark):
    assert c.clean(raw(spark)).dtypes == [(f.name, f.dataType.simpleString()) for f in files.clean_schema()]


def test_counts_and_pincode_reports(spark):
    first = c.counts_report(raw(spark)).where("measure = 'age_0_5'").first()
    assert (first.negatives, first.min, first.max) == (1, 0, 3)
    assert tuple(c.pincode_report(raw(spark)).first()) == (1, 2)
    assert c.invalid_date_count(c.parse_date(raw(spark))).first()[0] == 1


def test_numeric_names_are_dropped(spark):
    rows = [("Goa", "A"), ("12", "A"), ("1.2", "B"), ("Goa", "7"), (None, "A"), ("Goa", "2nd")]
    df = spark.createDataFrame(rows, "state string, district string")
    assert [tuple(r) for r in c.drop_numeric_names(df).orderBy("district").collect()] == [("Goa", "2nd"), ("Goa", "A")]


def test_label_encode_sorts_and_names_missing(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("Z",)], "state string")
    got = {r.state: r.state_encoded for r in c.label_encode(df, "state").collect()}
    assert got == {None: 0, "Z": 1, "a": 2, "b": 3}


def test_missing_and_duplicate_profiles(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (None, "y")], "a int, b string")
    got = {r.column: (r.missing, r.missing_pct) for r in p.missing_profile(df).collect()}
    assert got == {"a": (1, 25.0), "b": (2, 50.0)}
    assert tuple(p.duplicate_profile(df).first()) == (1, 25.0)


def test_describe_counts_every_record(spark, facts):
    got = {r.measure: r for r in p.describe_numeric(facts).collect()}
    total = got[D.total]
    assert (total["count"], total.min, total.p50, total.max, total.mean, total["std"]) == (6, 5, 8.5, 10, 8.0, 2.28)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "a bigint, b bigint")
    got = {(r.measure_a, r.measure_b): r.r for r in p.correlation_matrix(df, columns=["a", "b"]).collect()}
    assert got[("a", "b")] is None and abs(got[("a", "a")] - 1) < 1e-12


def test_histogram_keeps_the_maximum_and_empty_bins(spark):
    df = spark.createDataFrame([(0,), (0,), (10,)], "v bigint")
    got = p.equal_width_histogram(df, bins=5, columns=["v"]).orderBy("bin").collect()
    assert [r.rows for r in got] == [2, 0, 0, 0, 1]
    flat = p.equal_width_histogram(df.where("v = 0"), bins=2, columns=["v"]).orderBy("bin").collect()
    assert [(r.lower, r.upper, r.rows) for r in flat] == [(-0.5, 0.0, 0), (0.0, 0.5, 2)]


def test_boxplot_outliers(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 100)], "v bigint")
    r = p.boxplot_stats(df, columns=["v"]).first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2.25, 3.5, 4.75, 1.0, 5.0, 1)


def test_sample_is_stable_under_repartition(spark, facts):
    keys = ["date", "state", "district", "age_0_5"]
    one = {tuple(r) for r in p.sample_rows(facts, keys, 3).collect()}
    two = {tuple(r) for r in p.sample_rows(facts.repartition(5), keys, 3).collect()}
    assert len(one) == 3 and one == two


def test_files_round_trip(spark, tmp_path, facts):
    path = str(tmp_path / "raw")
    raw(spark).write.option("header", True).csv(path)
    assert files.read_raw_csv(spark, [path]).count() == 5
    assert files.raw_fallback_scan(spark, [path]).where("date IS NULL").count() == 1
    calls = []
    build = lambda: calls.append(1) or facts
    table = str(tmp_path / "table")
    files.materialize_if_absent(spark, table, build)
    assert files.materialize_if_absent(spark, table, build).count() == 6
    assert len(calls) == 1
    assert files.read_report(spark, str(tmp_path / "none"), "a int") is None
    assert not files.write_if_nonempty(facts.limit(0), str(tmp_path / "none"))


def test_union_shards_fills_missing_columns(spark):
    a, b = spark.range(1).selectExpr("id AS x", "id AS y"), spark.range(2).selectExpr("id AS y")
    got = files.union_shards(a, b)
    assert got.columns == ["x", "y"] and got.where("x IS NULL").count() == 2


def test_deviation_of_large_numbers_and_fractions(spark):
    big = spark.createDataFrame([(4_000_000_000,), (4_000_000_002,), (4_000_000_004,)], "v bigint")
    r = p.describe_numeric(big, columns=["v"]).first()
    assert (r["count"], r["mean"], r["std"]) == (3, 4_000_000_002.0, 2.0)
    small = spark.createDataFrame([(0.5,), (1.5,)], "v double")
    assert p.describe_numeric(small, columns=["v"]).first()["std"] == 0.71
