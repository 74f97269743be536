"""Incremental refresh: only new or changed shards are cleaned, only their months are written again.

Under the output folder stand ``staged`` (cleaned rows by shard version and month), ``clean`` (facts without
duplicates, by month), ``rollups/day_cube`` and ``rollups/pincode_months`` (by month), and ``manifest`` (the
shard versions and months of each finished refresh). A refresh first notes in ``started`` what it will work on;
one cut short is seen by the next, which does these months again. Every write replaces whole partitions, so
doing it twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregate, clean
from ..sources import files
from ..sources.scratch import pinned
from ..spec import DEFAULT, FactSpec
from .reports import Rollups

_MANIFEST = T.StructType([T.StructField("shard", T.LongType()), T.StructField("months", T.ArrayType(T.IntegerType())), T.StructField("version", T.IntegerType())])


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Write whole partitions, in files of even size; those without rows here stay as they are."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(path) if files.path_exists(spark, path) else spark.createDataFrame([], _MANIFEST)


def refresh(
    spark: SparkSession, raw_paths: str | Sequence[str], out_dir: str, spec: FactSpec = DEFAULT
) -> tuple[DataFrame, Rollups]:
    """The cleaned facts and both rollups of the raw shards as they are now.

    Exact duplicates agree in their date, so they are removed month by month, across shards. A shard that changed or
    went takes its rows with it. Months are numbers 1 to 12, as the calendar column has them. Rows staged for shard
    versions that are gone stay on disk, unread, until the folder's owner removes them.
    """
    paths = [raw_paths] if isinstance(raw_paths, str) else list(raw_paths)
    staged, table = f"{out_dir}/staged", f"{out_dir}/clean"
    cube, pins = f"{out_dir}/rollups/day_cube", f"{out_dir}/rollups/pincode_months"
    now = pinned(files.shard_versions(spark, paths), "shards")  # the list stays as it is while this runs
    known, started = _notes(spark, f"{out_dir}/manifest"), _notes(spark, f"{out_dir}/started")
    last = known.agg(F.max("version")).first()[0] or 0
    before = known.where(F.col("version") == last)
    fresh = now.join(before, "shard", "left_anti")
    gone = before.join(now, "shard", "left_anti").select("shard")
    unfinished = started.where(F.col("version") > last).select("shard")
    new_paths = [r.path for r in fresh.select("path").orderBy("path").toLocalIterator()]  # Spark's reader takes a list of paths
    work = fresh.select("shard").unionByName(gone).unionByName(unfinished).distinct()
    if new_paths or not work.isEmpty() or not last:
        note = work.select("shard", F.lit(None).cast("array<int>").alias("months"), F.lit(last + 1).alias("version"))
        note.write.mode("append").parquet(f"{out_dir}/started")
        work = _notes(spark, f"{out_dir}/started").where(F.col("version") > last).select("shard").distinct()
        if new_paths:
            rows = clean.clean_rows(files.read_raw_csv(spark, new_paths, spec, shard="shard_version"), spec, also=["shard_version"])
            _replace(rows.dropDuplicates().withColumn("month", F.month(spec.date)), staged, "shard_version", "month")
        if files.path_exists(spark, staged):
            every = spark.read.schema(_staged_schema(spec)).parquet(staged)
            live = every.join(now.select(F.col("shard").alias("shard_version")), "shard_version", "left_semi")
            touched = every.select("shard_version", "month").join(work.withColumnRenamed("shard", "shard_version"), "shard_version", "left_semi")
            touched = [r.month for r in touched.select("month").distinct().collect()]  # twelve at most
            months = [r.month for r in live.select("month").distinct().collect()]
            facts = live.where(F.col("month").isin(touched)).select(*spec.raw_columns).dropDuplicates()
            _replace(clean.derived(facts, spec).select(*_columns(spec)), table, "month")
            done = _facts(spark, table, touched, spec)
            _replace(aggregate.day_cube(done, spec).withColumn("month", F.month(spec.date)), cube, "month")
            _replace(_pincode_months(done, spec), pins, "month")
        else:
            months = []
        now.select("shard", F.lit(months).cast("array<int>").alias("months"), F.lit(last + 1).alias("version")).write.mode("append").parquet(f"{out_dir}/manifest")
    else:
        months = before.select("months").first().months if last else []
    facts = _facts(spark, table, months, spec)
    live_pins = spark.read.parquet(pins).where(F.col("month").isin(months)) if months else _pincode_months(facts, spec)
    live_cube = spark.read.parquet(cube).where(F.col("month").isin(months)).drop("month") if months else aggregate.day_cube(facts, spec)
    return facts, Rollups(live_cube, pincode_profile(live_pins, spec), spec)


def _staged_schema(spec: FactSpec) -> T.StructType:
    own = {f.name: f for f in files.clean_schema(spec)}
    return T.StructType([*(own[c] for c in spec.raw_columns), T.StructField("shard_version", T.LongType()), T.StructField("month", T.IntegerType())])


def _columns(spec: FactSpec) -> list[str]:
    return [f.name for f in files.clean_schema(spec)]


def _facts(spark: SparkSession, table: str, months: Sequence[int], spec: FactSpec) -> DataFrame:
    if not months:
        return spark.createDataFrame([], files.clean_schema(spec))
    return spark.read.schema(files.clean_schema(spec)).parquet(table).where(F.col("month").isin(list(months))).select(*_columns(spec))


def _pincode_months(facts: DataFrame, spec: FactSpec) -> DataFrame:
    """Sums and active days by pincode and month; a day is in one month, so days of months add up."""
    dated = facts.withColumn("month", F.month(spec.date))
    keys = spec.geo_keys("pincode")
    return clean.present(dated, *keys).groupBy(*keys, "month").agg(
        *[F.sum(c).alias(c) for c in spec.measures], F.count_distinct(spec.date).alias("active_days")
    )


def pincode_profile(months: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """The pincode profile, merged from its months."""
    keys = spec.geo_keys("pincode")
    return months.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in spec.measures], F.sum("active_days").alias("active_days"))
