"""Queries: the report bundles, flattened, and the batch pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import pipeline, reports
from ..sources.scratch import scratch_path
from .common import A, Registry, fixed_holidays, records
from .tables_queries import raw_shards

Q = Registry()
add = Q.add


def rollups(spark, sf):
    return reports.build_rollups(records(spark, sf), A)


@add("anomaly_report", 3)
def _(spark, sf):
    return reports.flatten(reports.anomaly_report(rollups(spark, sf), fixed_holidays(spark)))


@add("forecast_report", 3)
def _(spark, sf):
    return reports.flatten(reports.forecast_report(rollups(spark, sf)))


@add("clustering_report", 3)
def _(spark, sf):
    return reports.flatten(reports.clustering_report(rollups(spark, sf)))


@add("ml_report", 3)
def _(spark, sf):
    return reports.flatten(reports.ml_report(rollups(spark, sf)))


@add("operational_report", 3)
def _(spark, sf):
    return reports.flatten(reports.operational_report(rollups(spark, sf)))


@add("executive_summary", 3)
def _(spark, sf):
    return reports.flatten(reports.executive_summary(rollups(spark, sf)))


@add("full_pipeline")
def _(spark, sf):
    """Rows and digest of each report; that of the boosted trees, which only Spark fits alike, counts its features' names."""
    written = pipeline.run(spark, raw_shards(spark, sf), scratch_path(spark, "pipeline"), fmt="parquet")
    parts = []
    for name, path in written.items():
        found = spark.read.parquet(path)
        found = found.select("feature") if name == "feature_importance" else found
        parts.append(found.agg(F.count("*").alias("rows"), reports.digest(found).alias("digest")).select(F.lit(name).alias("output"), "rows", "digest"))
    return reduce(DataFrame.unionByName, parts)


@add("full_pipeline_quick")
def _(spark, sf):
    written = pipeline.run(spark, raw_shards(spark, sf), scratch_path(spark, "pipeline"), quick=True)
    return _sizes(spark, written, "csv")


def _sizes(spark, written, fmt="parquet"):
    """Rows of each written report."""
    out = None
    for name, path in written.items():
        found = spark.read.format(fmt).option("header", True).load(path)
        part = found.agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
