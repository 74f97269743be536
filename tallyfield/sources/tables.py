"""Adapter: fact views over the order tables and the event table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import FactSpec

ACTIVITY = FactSpec(
    parts=("part_a", "part_b", "part_c"),
    share_names=("pct_a", "pct_b", "pct_c"),
    total="total",
    measure="units",
)

_FLAGS = {"part_a": "R", "part_b": "A", "part_c": "N"}

#: Lines that one task sums to records, whatever the size of the tables; about 400 MB of aggregates.
LINES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measures() -> dict[str, Column]:
    quantity = F.col("l_quantity").cast("bigint")
    parts = {
        part: F.when(F.col("l_returnflag") == flag, quantity).otherwise(F.lit(0).cast("bigint"))
        for part, flag in _FLAGS.items()
    }
    return {**parts, "total": quantity}


def _with_places(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Add state and district by the order's customer.

    The tables are joined one after the other, so that Spark sees the size of
    each and broadcasts it or not by itself.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        rows.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumns({
            "state": F.col("n_name"), "district": F.concat("n_name", F.lit("/"), "c_mktsegment")
        })
    )


def _pincode() -> Column:
    return (F.lit(100000).cast("bigint") + F.col("o_custkey")).cast("string").alias("pincode")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (date, place): the record grain.

    Lines are summed per (order customer, day) before place names are joined
    on, so the wide aggregation shuffles two keys instead of four strings and
    the name join sees one row per record. Lines are dealt by customer and year into
    tasks of about ``LINES``: rollups by place and year fold inside a task, and a
    customer with very many lines has no more records than days.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.to_date("l_shipdate").alias("date"), *_named(_measures())
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(lines.count() / LINES))
    records = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("_year", F.year("date"))
        .repartition(tasks, "o_custkey", "_year")
        .groupBy("date", "o_custkey", "_year")
        .agg(*[F.sum(c).alias(c) for c in ACTIVITY.measures])
    )
    return _with_places(spark, sf_dir, records).select(
        "date", "state", "district", _pincode(), *ACTIVITY.measures
    )


def activity_lines(
    spark: SparkSession, sf_dir: str, dims: Sequence[str] = ("date",)
) -> DataFrame:
    """The same facts at line grain, with only the requested dimensions.

    Sums and distinct counts do not care how a record is split, so operators
    made of those skip the record aggregation. Every line has its order and
    every order its customer (foreign keys), so a join that no requested
    dimension needs is left out: a daily series reads ``lineitem`` alone.
    """
    out = table(spark, sf_dir, "lineitem").withColumns(
        {"date": F.to_date("l_shipdate"), **_measures()}
    )
    placed = bool({"state", "district"} & set(dims))
    if placed or "pincode" in dims:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if placed:
        out = _with_places(spark, sf_dir, out)
    chosen = [_pincode() if d == "pincode" else F.col(d) for d in dims]
    return out.select(*chosen, *ACTIVITY.measures)


def segment_lines(spark: SparkSession, sf_dir: str, dims: Sequence[str]) -> DataFrame:
    """Line-grain facts whose district name is shared by several states."""
    lines = activity_lines(spark, sf_dir, tuple(dict.fromkeys((*dims, "district"))))
    return lines.withColumn("district", F.split_part("district", F.lit("/"), F.lit(2)))


def segment_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-grain facts whose district name is shared by several states."""
    return activity(spark, sf_dir).withColumn(
        "district", F.split_part("district", F.lit("/"), F.lit(2))
    )


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number event values by day and type: a short second domain."""
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("state"),
        F.floor(F.col("value") * 100).cast("bigint").alias("total"),
    )


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows with the flaws real files have, made from every order.

    Which flaw a row carries follows from its keys alone, so the same rows can
    be written in plain SQL. A slice is repeated to give exact duplicates.
    """
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = (
        F.when(k % 50 == 0, "31-02-2025")
        .when(k % 50 == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 50 == 2, F.date_format(d, "d-M-yyyy"))
        .otherwise(F.date_format(d, "dd-MM-yyyy"))
    )
    state = (
        F.when(k % 40 == 0, "None")
        .when(k % 40 == 1, F.concat(F.lit("  "), F.lower("n_name"), F.lit("* ")))
        .when(k % 40 == 2, "")
        .when(k % 40 == 3, "*")
        .otherwise(F.lower("n_name"))
    )
    district = (
        F.when(k % 45 == 0, "nan")
        .when(k % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit("-EAST")))
        .when(k % 3 == 1, F.concat(F.lit("o'"), F.lower("c_mktsegment"), F.lit(" 2nd#")))
        .otherwise(F.col("c_mktsegment"))
    )
    pincode = (
        F.when(F.col("o_custkey") % 20 == 0, "1234")
        .when(F.col("o_custkey") % 20 == 1, "12a456")
        .otherwise(F.concat((100000 + F.col("o_custkey")).cast("string"), F.lit(" ")))
    )
    first = (
        F.when(k % 30 == 0, "abc").when(k % 30 == 1, "-5").when(k % 30 == 2, "3.7")
        .when(k % 30 == 3, "1e3").when(k % 30 == 4, " 12 ").when(k % 30 == 5, "")
        .when(k % 30 == 6, "NaN").when(k % 30 == 7, "5d")
        .otherwise((k % 7).cast("string"))
    )
    raw = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("k"), date.alias("date"), state.alias("state"), district.alias("district"),
            pincode.alias("pincode"), first.alias("age_0_5"),
            (k % 11).cast("string").alias("age_5_17"),
            F.floor(F.col("o_totalprice") / 1000).cast("bigint").cast("string").alias("age_18_greater"),
        )
    )
    copies = F.when(F.col("k") % 25 == 7, F.sequence(F.lit(0), F.lit(1))).otherwise(
        F.sequence(F.lit(0), F.lit(0))
    )
    return raw.select("*", F.explode(copies).alias("copy")).drop("k", "copy")
