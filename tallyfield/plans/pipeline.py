"""The batch job: raw files to cleaned table, rollups and report files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators import joins
from ..sources import files, scratch
from ..spec import DEFAULT, FactSpec
from . import refresh, reports

# Report file names, and the section each one holds.
ANOMALY_FILES = {
    "anomalies_zscore": "zscore_anomalies",
    "anomalies_geographic": "geo_anomalies",
    "anomalies_holiday_impact": "holiday_impact",
}
FORECAST_FILES = {"forecast_30day": "seasonal_forecast", "milestone_projections": "milestones"}
CLUSTERING_FILES = {"district_clusters": "district_clusters", "underserved_districts": "underserved"}
ML_FILES = {"feature_importance": "feature_importance", "district_risk_scores": "district_risk"}
OPERATIONAL_FILES = {
    "seasonality_index": "seasonality",
    "recommendations": "recommendations",
    "capacity_utilization": "capacity",
}


def run(
    spark: SparkSession,
    raw_paths: Sequence[str],
    out_dir: str,
    quick: bool = False,
    holidays: DataFrame | None = None,
    spec: FactSpec = DEFAULT,
    fmt: str = "csv",
) -> dict[str, str]:
    """Clean, roll up and write every report file; returns report name to path. Models that no file holds are not fitted.

    ``quick`` stops after anomalies and forecasts. The cleaned table and the
    rollups are kept, so a second run over the same files, or one after a
    failure, starts there; new, changed or missing files cost their months only
    (``refresh``). A failing report fails the job. Scratch tables go when it ends, either way.
    """
    with scratch.scope(spark):
        return _run(spark, raw_paths, out_dir, quick, holidays, spec, fmt)


def _run(
    spark: SparkSession, raw_paths: Sequence[str], out_dir: str, quick: bool, holidays: DataFrame | None, spec: FactSpec, fmt: str
) -> dict[str, str]:
    _, r = refresh.refresh(spark, raw_paths, out_dir, spec)
    r = replace(r, pincodes=scratch.pinned(r.pincodes, "pincodes"))  # most reports read it
    written: dict[str, str] = {}

    def save(report: reports.Report, names: dict[str, str], skip_empty: bool = False) -> None:
        for file_name, section in names.items():
            path = f"{out_dir}/reports/{file_name}"
            if skip_empty:
                if not files.write_if_nonempty(report[section], path, fmt):
                    continue
            else:
                files.write_report(report[section], path, fmt)
            written[file_name] = path

    calendar = joins.holiday_calendar(spark) if holidays is None else holidays
    save(reports.anomaly_report(r, calendar), ANOMALY_FILES, skip_empty=True)
    forecasts = reports.forecast_report(r)
    forecasts["seasonal_forecast"] = forecasts["seasonal_forecast"].drop("step")
    save(forecasts, FORECAST_FILES)
    if not quick:
        save(reports.clustering_report(r, sections=list(CLUSTERING_FILES.values())), CLUSTERING_FILES)
        save(reports.ml_report(r, sections=list(ML_FILES.values())), ML_FILES)
        operational = reports.operational_report(r)
        operational["recommendations"] = operational["recommendations"].drop("position")
        save(operational, OPERATIONAL_FILES)
    return written
