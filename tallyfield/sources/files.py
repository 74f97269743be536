"""CSV and Parquet sources and sinks."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar, numeric
from ..spec import DEFAULT, FactSpec
from .scratch import memoized as memoized
from .workers import importable

_CALENDAR_TYPES = {
    "year": T.IntegerType(),
    "month": T.IntegerType(),
    "day": T.IntegerType(),
    "day_of_week": T.IntegerType(),
    "day_name": T.StringType(),
    "month_name": T.StringType(),
    "quarter": T.IntegerType(),
    "week_of_year": T.IntegerType(),
}


def raw_schema(spec: FactSpec = DEFAULT) -> T.StructType:
    """All text: types are decided by the cleaners, never inferred."""
    return T.StructType([T.StructField(c, T.StringType()) for c in spec.raw_columns])


def clean_schema(spec: FactSpec = DEFAULT) -> T.StructType:
    """The sixteen columns of a cleaned fact table."""
    fields = [T.StructField(spec.date, T.DateType())]
    fields += [T.StructField(c, T.StringType()) for c in (spec.state, spec.district, spec.pincode)]
    fields += [T.StructField(c, T.LongType()) for c in spec.parts]
    fields += [T.StructField(c, t) for c, t in _CALENDAR_TYPES.items()]
    fields.append(T.StructField(spec.total, T.LongType()))
    return T.StructType(fields)


def read_raw_csv(
    spark: SparkSession, paths: str | Sequence[str], spec: FactSpec = DEFAULT, shard: str | None = None
) -> DataFrame:
    """Read headered CSV shards (files, folders or globs), columns by name.

    Shards of one header are one scan, and one job reads all headers. A shard may order its columns
    differently, have more or lack some (null); one without date, state or district is an error, an
    empty file is none. ``shard`` names a column that tells the version of the file each row is of.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts, names = [], [*spec.raw_columns, *([shard] if shard else [])]
    for r in shard_headers(spark, paths).groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("files")).orderBy("files").collect():
        if lacking := [c for c in (spec.date, spec.state, spec.district) if c not in r.header]:
            raise ValueError(f"{r.files[0]} has no column {', '.join(lacking)}")
        text = T.StructType([T.StructField(c, T.StringType()) for c in r.header])
        own = csv_reader(spark).schema(text).csv(r.files)
        version = [file_version().alias(shard)] if shard else []
        parts.append(own.select(*[c for c in spec.raw_columns if c in r.header], *version))
    empty = T.StructType([*raw_schema(spec), *([T.StructField(shard, T.LongType())] if shard else [])])
    whole = union_shards(spark.createDataFrame([], empty), *parts) if len(parts) != 1 else parts[0]
    return whole.select(*[F.col(c) if c in whole.columns else F.lit(None).cast("string").alias(c) for c in names])


def file_version() -> Column:
    """A number that changes with a file's path, size or modification time; a column of any file scan."""
    return F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")


def shard_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, header): the first line of each file, as names, from one distributed job.

    Only the part of a file that begins it is looked at; a task whose part is not the end of its file holds
    nothing else, and stops after the line.
    """
    importable(spark)

    def first_lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, out, more = set(), [], True
        for batch in rows:
            for path, line, start, length, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if path not in seen:
                    seen.add(path)
                    if start == 0:
                        names = next(csv.reader([line.lstrip("\ufeff")]), [])
                        out.append((unquote(path), [c.strip() for c in names]))
                    more = start + length >= size
            if not more:
                break
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in out], pa.string()), pa.array([h for _, h in out], pa.list_(pa.string()))], names=["path", "header"]
        )

    at = [F.col(f"_metadata.{c}") for c in ("file_block_start", "file_block_length", "file_size")]
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path"), "value", *at).mapInArrow(first_lines, "path string, header array<string>")


def csv_reader(spark: SparkSession) -> DataFrameReader:
    """Headered CSV with quotes doubled inside quotes."""
    return spark.read.option("header", True).option("escape", '"')


def shard_versions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, shard): the files under the paths with their versions, listed without being read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", file_version().alias("shard"))


def read_clean(
    spark: SparkSession, path: str, fmt: str = "parquet", spec: FactSpec = DEFAULT
) -> DataFrame:
    """Read a cleaned fact table with its fixed schema."""
    if fmt == "csv":
        names = csv_reader(spark).csv(path).columns
        kinds = {f.name: f for f in clean_schema(spec)}
        own = T.StructType([kinds.get(c, T.StructField(c, T.StringType())) for c in names])
        return csv_reader(spark).schema(own).csv(path).select(*kinds)
    return spark.read.schema(clean_schema(spec)).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when Spark can list at least one file at the path."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def materialize_if_absent(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
    inputs: str = "",
) -> DataFrame:
    """Write ``build()`` as Parquet unless the path holds a finished table of the same ``inputs``.

    The commit marker decides, so a write cut short is done again; ``inputs`` is kept
    beside the table, after it is finished, and a difference makes the table anew.
    """
    note = f"{path}.inputs"
    known = spark.read.text(note).first() if path_exists(spark, f"{note}/_SUCCESS") else None
    if not path_exists(spark, f"{path}/_SUCCESS") or (known.value if known else "") != inputs:
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        spark.range(1).select(F.lit(inputs).alias("value")).write.mode("overwrite").text(note)
    return spark.read.parquet(path)


def raw_fallback_scan(
    spark: SparkSession, paths: str | Sequence[str], spec: FactSpec = DEFAULT
) -> DataFrame:
    """Read raw shards with only the date, total and six calendar columns derived."""
    return derive_minimum(read_raw_csv(spark, paths, spec), spec)


def derive_minimum(raw: DataFrame, spec: FactSpec = DEFAULT) -> DataFrame:
    """Parse the date and add total and calendar columns, cleaning nothing else."""
    d = F.col(spec.date)
    cal = calendar.calendar_columns(d)
    keep = ("year", "month", "day_of_week", "day_name", "month_name", "quarter")
    counts = {c: numeric.parse_number(F.col(c)).try_cast("bigint") for c in spec.parts}
    return (
        raw.withColumns({spec.date: calendar.parse_day_first(d), **counts})
        .withColumn(spec.total, sum((F.col(c) for c in spec.parts[1:]), F.col(spec.parts[0])))
        .withColumns({name: cal[name] for name in keep})
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write a result: headered CSV by default, or Parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def write_if_nonempty(df: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Write only when there is at least one row; says whether it wrote."""
    if df.isEmpty():
        return False
    write_report(df, path, fmt)
    return True


def read_report(
    spark: SparkSession, path: str, schema: T.StructType | str
) -> DataFrame | None:
    """Read a saved CSV report, or ``None`` when it was never written."""
    if not path_exists(spark, path):
        return None
    return csv_reader(spark).schema(schema).csv(path)


def union_shards(*frames: DataFrame) -> DataFrame:
    """Concatenate by column name; columns a shard lacks become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
