"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder (default /root/testdata/sf0.1), BENCH_CPUS
the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyfield.catalog.queries import all_queries  # noqa: E402

HEADLINE = (
    "clean_pipeline", "describe_numeric", "boxplot_by_state", "correlation_matrix",
    "daily_total", "state_total", "district_features", "hierarchy_rollup", "pivot_state_month",
    "top_pincodes", "percentile_rank_avg", "semi_top_states",
    "anomaly_zscore", "anomaly_iqr", "anomaly_runs", "seasonal_decompose", "anomaly_geo", "anomaly_pincode",
    "holiday_impact", "forecast_ma", "forecast_holt", "forecast_seasonal", "forecast_by_state", "milestones",
    "underserved", "district_risk", "demand_features", "kpi_overall", "kpi_temporal", "kpi_geographic",
    "capacity_utilization", "seasonality_index", "recommendations",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyfield-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = sys.argv[1:] or HEADLINE
    spark = session()
    for name in ("daily_total", "district_features"):
        run(spark, name, sf_dir)  # start the JVM's compilers
    times = {name: round(run(spark, name, sf_dir), 3) for name in chosen}
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
