"""Registered queries against their SQL, and properties of their plans."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tests.compare import differences, duck_rows, spark_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = contract.oracle_sql()
QUICK = [
    "clean_pipeline", "read_raw_csv", "describe_numeric", "histogram50", "boxplot_by_state", "correlation_matrix",
    "daily_total", "resample_weekly", "hierarchy_rollup", "pivot_state_month", "quantile_linear_records",
    "rolling_mean_strict_by_type", "run_ids", "percentile_rank_avg", "rank_first_tercile", "cumulative_share",
    "interval_neighbors", "semi_top_states", "top_with_others", "anomaly_zscore", "anomaly_runs",
    "seasonal_decompose", "anomaly_geo_scores", "top_bottom_pincodes", "holiday_impact", "forecast_holt",
    "forecast_by_state", "milestones", "underserved", "district_risk", "classification_metrics",
    "recommendations", "kpi_geographic", "radar_metrics", "executive_summary",
]
# Set CHECK_ALL=1 to compare every query with its SQL.
CHECKED = sorted(SQL) if os.environ.get("CHECK_ALL") else QUICK
LINES = pytest.importorskip("pyarrow.parquet").ParquetFile(f"{SF}/lineitem.parquet").metadata.num_rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    ours = spark_rows(contract.queries()[name](spark, SF))
    assert differences(ours, duck_rows(duck, SQL[name])) is None


def test_every_sql_belongs_to_a_query():
    assert SQL.keys() <= contract.queries().keys()


def test_entry_runs(spark):
    assert "z_score" in contract.entry(spark).columns


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_daily_series_reads_one_table_and_two_columns(spark):
    plan = final_plan(contract.queries()["daily_total"](spark, SF))
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["underserved", "district_features", "anomaly_geo", "district_risk", "radar_metrics", "top_performers"])
def test_distinct_counts_copy_no_rows_and_read_facts_once(spark, name):
    plan = final_plan(contract.queries()[name](spark, SF))
    assert "Expand" not in plan and sum("FileScan" in x and "lineitem.parquet" in x for x in plan.splitlines()) == 1


@pytest.mark.parametrize("name", ["describe_numeric", "percentile_rank_avg", "state_total", "clean_pipeline"])
def test_large_grains_never_meet_in_one_task(spark, name):
    """The only single-task exchanges are over buckets, days and other bounded sets."""
    df = contract.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange SinglePartition" in line:
            below = plan.splitlines()[plan.splitlines().index(line) + 1:][:6]
            assert any("bucket" in x for x in below), plan


@pytest.mark.parametrize("name", ["top_states", "top_pincodes", "sample_rows"])
def test_top_k_does_not_sort_everything(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("name", sorted(SQL.keys() & {
    "anomaly_zscore", "district_risk", "holiday_impact", "kpi_temporal", "forecast_by_state", "boxplot_by_state",
}))
def test_no_nested_loop_or_cartesian_joins(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from tallyfield.sources import scratch

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///tmp/x/"
    assert scratch.scratch_path(Session(), "a").startswith("hdfs:///tmp/x/a-")


def test_pipeline_can_resume(spark, tmp_path):
    from tallyfield.catalog.tables_queries import raw_shards
    from tallyfield.plans import pipeline

    paths, out = raw_shards(spark, SF), str(tmp_path)
    first = pipeline.run(spark, paths, out, quick=True)
    assert {"forecast_30day", "milestone_projections"} <= first.keys()
    written = next((tmp_path / "clean").rglob("*.parquet")).stat().st_mtime_ns
    assert pipeline.run(spark, paths, out, quick=True) == first
    assert next((tmp_path / "clean").rglob("*.parquet")).stat().st_mtime_ns == written
    rows = spark.read.option("header", True).csv(first["forecast_30day"])
    assert rows.columns == ["date", "forecast", "lower_bound", "upper_bound"] and rows.count() == 30


def test_pipeline_sees_a_new_shard(spark, tmp_path):
    from tallyfield.plans import pipeline
    from tallyfield.sources import files

    head = "date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n"
    (tmp_path / "a.csv").write_text(head + "".join(f"{d:02}-01-2025,Goa,North,403001,1,2,{d}\n" for d in range(1, 29)))
    paths, out = [str(tmp_path / "*.csv")], str(tmp_path / "out")
    pipeline.run(spark, paths, out, quick=True)
    before = spark.read.parquet(f"{out}/rollups/day_cube").count()
    (tmp_path / "b.csv").write_text('state,date,district,age_0_5,more\nGoa,02-02-2025,"No ""x"" rth, A",7,z\n')
    pipeline.run(spark, paths, out, quick=True)
    assert spark.read.parquet(f"{out}/rollups/day_cube").count() == before + 1
    row = files.read_raw_csv(spark, paths).where("date = '02-02-2025'").first()
    assert (row.state, row.district, row.age_0_5, row.pincode) == ("Goa", 'No "x" rth, A', "7", None)
    (tmp_path / "c.csv").write_text("date,district\n03-02-2025,North\n")
    with pytest.raises(ValueError, match="state"):
        files.read_raw_csv(spark, paths)
