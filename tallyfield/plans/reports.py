"""Report bundles: named lazy frames over two rollups of the facts.

The facts are read twice, once per rollup. Everything a report needs except
record-grain distributions follows from these small tables, so adding a section
costs no further pass over the facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregate, anomaly, forecast, kpi, learn, profile, segment, select, series
from ..sources.scratch import pinned
from ..spec import DEFAULT, FactSpec

Report = dict[str, DataFrame]


@dataclass(frozen=True)
class Rollups:
    """Day cube and pincode profile of one fact table."""

    cube: DataFrame
    pincodes: DataFrame
    spec: FactSpec = DEFAULT

    @property
    def daily(self) -> DataFrame:
        return aggregate.daily_total(self.cube, self.spec)


def build_rollups(facts: DataFrame, spec: FactSpec = DEFAULT) -> Rollups:
    """Roll the facts up and pin both tables to scratch."""
    return Rollups(
        pinned(aggregate.day_cube(facts, spec), "cube"),
        pinned(aggregate.pincode_profile(facts, spec), "pincodes"),
        spec,
    )


def _counts(sections: Report) -> DataFrame:
    """Rows per section."""
    frames = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("section"), "rows")
        for name, df in sections.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def anomaly_report(r: Rollups, holidays: DataFrame) -> Report:
    """Every detector with its defaults, and the number of findings of each."""
    daily, spec = r.daily, r.spec
    geo = anomaly.geo_scores(r.cube, spec, pincodes=r.pincodes)
    found = {
        "zscore_anomalies": anomaly.detect_zscore(daily),
        "iqr_anomalies": anomaly.detect_iqr(daily),
        "consecutive_anomalies": anomaly.detect_runs(daily),
        "residual_anomalies": anomaly.residual_anomalies(daily),
        "geo_anomalies": geo.where("is_anomaly"),
        "holiday_impact": anomaly.holiday_impact(daily, holidays, spec),
    }
    iqr = anomaly.iqr_daily(daily)
    return {
        **found,
        "daily_zscore": anomaly.zscore_daily(daily),
        "daily_iqr": iqr,
        "iqr_bounds": iqr.select("lower_bound", "upper_bound").distinct(),
        "daily_consecutive": anomaly.deviation_daily(daily),
        "decomposition": anomaly.seasonal_decompose(daily),
        "geo_data": geo,
        "baseline": anomaly.holiday_baseline(daily, holidays),
        "summary": _counts(found),
    }


def forecast_report(r: Rollups, periods: int = 30) -> Report:
    daily = r.daily
    by_season = forecast.seasonal(daily, periods)
    return {
        "time_series": daily,
        "ma_forecast": forecast.moving_average(daily, periods),
        "exp_forecast": forecast.holt(daily, periods),
        "seasonal_forecast": by_season,
        "seasonal_factors": forecast.seasonal_factors(daily),
        "state_forecasts": forecast.by_state(r.cube, r.spec, periods),
        "milestones": forecast.milestones(daily),
        "cumulative": series.cumulative_sum(daily),
        "summary": forecast.summarize(by_season),
    }


def _asked(sections: Sequence[str] | None, *names: str) -> bool:
    return sections is None or not set(names).isdisjoint(sections)


def clustering_report(r: Rollups, restarts: int = 10, sections: Sequence[str] | None = None) -> Report:
    """State and district clusters, underserved districts, pincode zones; of these only ``sections``, if given, are fitted."""
    spec, out = r.spec, {}
    for level, n in (("state", 4), ("district", 5)):
        names = f"{level}_clusters", f"{level}_profiles"
        if _asked(sections, *names):
            places, profiles, _ = segment.cluster_regions(r.cube, spec, level, n, restarts=restarts, pincodes=r.pincodes)
            out |= zip(names, (places, profiles))
    if _asked(sections, "underserved"):
        out["underserved"] = segment.underserved(r.cube, spec, r.pincodes)
    if _asked(sections, "pincode_clusters", "pincode_summary"):
        zones, zone_summary = segment.cluster_pincodes(r.cube, spec, restarts=restarts, profile=r.pincodes)
        out |= {"pincode_clusters": zones, "pincode_summary": zone_summary}
    return {name: df for name, df in out.items() if _asked(sections, name)}


def ml_report(r: Rollups, sections: Sequence[str] | None = None) -> Report:
    """Models and risk; only the models of ``sections``, if given, are fitted."""
    spec, out = r.spec, {}
    if _asked(sections, "demand_importance", "demand_metrics"):
        _, out["demand_importance"], out["demand_metrics"] = learn.train_demand(r.cube, spec)
    if _asked(sections, "surge_report"):
        _, out["surge_report"], _ = learn.train_surge(r.cube, spec)
    risk = learn.district_risk(r.cube, spec, r.pincodes)
    out |= {"district_risk": risk, "risk_summary": learn.risk_summary(risk)}
    if _asked(sections, "feature_importance"):
        out["feature_importance"] = learn.feature_importance(r.cube, spec)
    return {name: df for name, df in out.items() if _asked(sections, name)}


def operational_report(
    r: Rollups, assumed_centers_per_district: int = 5, capacity_per_center: int = 100
) -> Report:
    spec = r.spec
    kpis = kpi.merged_kpis(r.pincodes, spec, r.cube)
    return {
        "overall_kpis": kpi.overall(r.pincodes, spec, r.cube),
        "temporal_kpis": kpi.temporal(r.cube, spec),
        "geographic_kpis": kpi.geographic(r.cube, spec),
        "capacity": kpi.capacity_utilization(
            r.cube, spec, assumed_centers_per_district, capacity_per_center
        ),
        "efficiency": kpi.weekday_weekend(r.cube, spec),
        "day_breakdown": kpi.weekday_breakdown(r.cube, spec),
        "seasonality": kpi.seasonality_index(r.cube, spec),
        "recommendations": kpi.recommendations(kpis, spec.measure),
    }


def executive_summary(r: Rollups) -> Report:
    """The nine panels of the one-page overview."""
    spec, cube = r.spec, r.cube
    return {
        "age_groups": aggregate.part_totals(cube, spec),
        "top_states": select.top_states(cube, spec),
        "daily": r.daily,
        "weekdays": aggregate.weekday_total(cube, spec, fill=0),
        "months": aggregate.monthly_total(cube, spec),
        "quarters": aggregate.quarter_total(cube, spec),
        "monthly_age_groups": aggregate.monthly_part_totals(cube, spec),
        "cumulative": series.cumulative_sum(r.daily),
        "coverage": profile.coverage_summary(cube, spec, r.pincodes),
    }


_NUMBERS = (T.IntegerType, T.LongType, T.DoubleType)


def digest(df: DataFrame, digits: int = 3) -> Column:
    """Aggregate over the rows: a number that tells whole tables apart, whatever the order of rows and columns.

    A row is its columns in the order of their names, as name=value; numbers are rounded and written as whole units
    of the last digit, dates as text, missing values as ~. Each row's MD5 gives 40 bits, and these are summed modulo 2^40.
    """
    def cell(f: T.StructField) -> Column:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            # first as results are rounded everywhere, so that a value on an edge falls to one side
            column = F.round(F.round(column.cast("double"), 6) * 10**digits).cast("bigint")
        return F.concat(F.lit(f.name + "="), F.coalesce(column.cast("string"), F.lit("~")))

    row = F.concat_ws("|", *[cell(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    bits = F.conv(F.substring(F.md5(row), 1, 10), 16, 10).cast("decimal(20,0)")
    return F.coalesce(F.pmod(F.sum(bits), F.lit(1 << 40).cast("decimal(20,0)")).cast("double"), F.lit(0.0))


def flatten(report: Report, sections: Sequence[str] | None = None, digits: int = 6, digests: Sequence[str] | None = None) -> DataFrame:
    """A report as (section, key, value): its row count, the sum of each number column, and the digest of all its rows.

    ``digests`` names the sections that get a digest; all do without it.
    """
    out = None
    for name in sections or report:
        df = report[name]
        numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMBERS)]
        cells = [F.struct(F.lit("rows").alias("key"), F.count("*").cast("double").alias("value"))]
        cells += [
            F.struct(F.lit(c).alias("key"), F.sum(F.round(c, digits)).cast("double").alias("value"))
            for c in numbers
        ]
        if digests is None or name in digests:
            cells.append(F.struct(F.lit("digest").alias("key"), digest(df).alias("value")))
        part = df.agg(F.array(*cells).alias("c")).select(F.lit(name).alias("section"), F.inline("c"))
        out = part if out is None else out.unionByName(part)
    return out
