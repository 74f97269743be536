"""Queries: sources, cleaning, profiling, aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar, numeric, text
from ..operators import aggregate as g
from ..operators import clean as c
from ..operators import profile as p
from ..operators import quantile
from ..sources import files, tables
from ..sources.scratch import scratch_path
from .common import A, Registry, daily, districts, lines, records, states
from ..spec import DEFAULT as D

Q = Registry()
add = Q.add


# --- sources and sinks -------------------------------------------------------

def raw_shards(spark, sf):
    """The raw rows as three CSV shards under scratch."""
    base = scratch_path(spark, "raw")
    raw = tables.dirty_orders(spark, sf)
    shard = F.pmod(F.xxhash64(*raw.columns), F.lit(3))
    (
        raw.withColumn("shard", shard).write.partitionBy("shard").option("header", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(base)
    )
    return [f"{base}/shard={i}" for i in range(3)]


@add("read_raw_csv")
def _(spark, sf):
    return files.read_raw_csv(spark, raw_shards(spark, sf))


@add("read_clean")
def _(spark, sf):
    path = scratch_path(spark, "clean")
    c.clean(tables.dirty_orders(spark, sf)).write.parquet(path)
    return files.read_clean(spark, path)


@add("materialize_if_absent")
def _(spark, sf):
    path = scratch_path(spark, "clean")
    for _ in range(2):
        table = files.materialize_if_absent(
            spark, path, lambda: c.clean(tables.dirty_orders(spark, sf))
        )
    return table


@add("raw_fallback_scan")
def _(spark, sf):
    return files.raw_fallback_scan(spark, raw_shards(spark, sf))


@add("raw_fallback_totals")
def _(spark, sf):
    """Rows without a readable date or a state are in no group."""
    facts = files.raw_fallback_scan(spark, raw_shards(spark, sf))
    found = [
        (kind, df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("bigint").alias("value")))
        for kind, key, df, value in (
            ("month", "month", g.monthly_total(facts), "value"), ("week", "week", g.weekly_total(facts), "value"),
            ("month name", "month_name", g.month_name_total(facts), "value"),
            ("state", "state", g.state_total(facts), "total_enrollments"),
        )
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "key", "value") for kind, df in found])


@add("memoized_scan")
def _(spark, sf):
    return g.state_total(files.memoized(lines(spark, sf, "state")), A)


@add("write_report_csv")
def _(spark, sf):
    path = files.write_report(states(spark, sf), scratch_path(spark, "report"))
    return spark.read.schema("state string, total bigint").option("header", True).csv(path)


@add("write_if_nonempty")
def _(spark, sf):
    from ..operators import anomaly

    path = scratch_path(spark, "report")
    found = anomaly.detect_zscore(daily(spark, sf)).drop("z_score")
    empty = files.write_if_nonempty(found.limit(0), path)
    wrote = files.write_if_nonempty(found, path)
    out = spark.read.schema(found.schema).option("header", True).csv(path)
    return out.withColumns({"wrote_empty": F.lit(empty), "wrote": F.lit(wrote)})


@add("read_report")
def _(spark, sf):
    path = files.write_report(districts(spark, sf), scratch_path(spark, "report"))
    missing = files.read_report(spark, path + "-never-written", "a int")
    found = files.read_report(spark, path, "state string, district string, total bigint")
    return found.withColumn("missing_is_skipped", F.lit(missing is None))


@add("export_filtered")
def _(spark, sf):
    from ..operators import select as e

    view = e.filter_date_range(records(spark, sf), "1998-01-01", "1998-12-31", A)
    view = e.filter_value_range(e.filter_states(view, ["NATION_1", "NATION_7"], A), 10, 40, A)
    path = files.write_report(view, scratch_path(spark, "export"))
    return files.read_report(spark, path, view.schema)


# --- cleaning ----------------------------------------------------------------

@add("parse_date")
def _(spark, sf):
    raw = tables.dirty_orders(spark, sf).withColumn("raw_date", F.col("date"))
    return c.parse_date(raw).groupBy("raw_date", "date").agg(F.count("*").alias("n"))


@add("invalid_date_count")
def _(spark, sf):
    return c.invalid_date_count(c.parse_date(tables.dirty_orders(spark, sf)))


@add("calendar_columns")
def _(spark, sf):
    return c.add_calendar(daily(spark, sf))


@add("weekend_month_edge_flags")
def _(spark, sf):
    return c.add_edge_flags(daily(spark, sf))


@add("normalize_text")
def _(spark, sf):
    raw = tables.dirty_orders(spark, sf).select(
        F.col("state").alias("raw_state"), F.col("district").alias("raw_district"), "state", "district"
    )
    return c.normalize_names(raw).distinct()


@add("normalize_text_strict")
def _(spark, sf):
    raw = tables.dirty_orders(spark, sf).select("state", "district")
    return c.normalize_names(raw, strict=True).groupBy("state").agg(F.count("*").alias("n"))


@add("null_tokens")
def _(spark, sf):
    raw = tables.dirty_orders(spark, sf)
    token = text.null_tokens(text.title_case(F.col("state")))
    return raw.select(token.alias("state")).agg(
        F.count_if(F.col("state").isNull()).alias("missing"), F.count("state").alias("present")
    )


@add("validate_pincode")
def _(spark, sf):
    valid = c.validate_pincode(tables.dirty_orders(spark, sf))
    return valid.groupBy("pincode").agg(F.count("*").alias("n"))


@add("pincode_report")
def _(spark, sf):
    return c.pincode_report(tables.dirty_orders(spark, sf))


@add("coerce_counts")
def _(spark, sf):
    raw = tables.dirty_orders(spark, sf).withColumn("raw_count", F.col("age_0_5"))
    return c.coerce_counts(raw).groupBy("raw_count", "age_0_5").agg(
        F.count("*").alias("n"), F.sum("age_18_greater").alias("sum_c")
    )


@add("counts_report")
def _(spark, sf):
    return c.counts_report(tables.dirty_orders(spark, sf))


@add("row_total")
def _(spark, sf):
    rows = c.add_row_total(c.coerce_counts(tables.dirty_orders(spark, sf)))
    return rows.groupBy(D.total).agg(F.count("*").alias("n"))


@add("drop_exact_duplicates")
def _(spark, sf):
    return c.drop_exact_duplicates(tables.dirty_orders(spark, sf))


@add("drop_missing_critical")
def _(spark, sf):
    return c.drop_missing_critical(c.normalize_names(c.parse_date(tables.dirty_orders(spark, sf))))


@add("clean_pipeline")
def _(spark, sf):
    return c.clean(tables.dirty_orders(spark, sf))


@add("drop_numeric_names")
def _(spark, sf):
    raw = lines(spark, sf, "state", "district", "pincode")
    odd = F.when(F.col("state") == "NATION_3", "12.5").when(F.col("state") == "NATION_4", None)
    named = raw.withColumn("state", odd.when(F.col("state") == "NATION_5", "5").otherwise(F.col("state")))
    return g.state_total(c.drop_numeric_names(named, A), A)


@add("share_columns")
def _(spark, sf):
    return c.add_shares(records(spark, sf), A)


@add("per_unit_averages")
def _(spark, sf):
    base = g.geo_profile(lines(spark, sf, "date", "state", "pincode"), A)
    return base.withColumns({
        "per_day": numeric.ratio(F.col("total"), F.col("active_days")),
        "per_pincode": numeric.ratio(F.col("total"), F.col("unique_pincodes")),
    })


@add("label_encode")
def _(spark, sf):
    rows = lines(spark, sf, "state").withColumn(
        "state", F.when(F.col("state") != "NATION_9", F.col("state"))
    )
    coded = c.label_encode(rows, "state")
    return coded.groupBy("state_encoded", F.coalesce("state", F.lit("Unknown")).alias("label")).agg(
        F.sum("total").alias("total")
    )


@add("fill_null")
def _(spark, sf):
    from ..operators import series

    lagged = series.lag_features(daily(spark, sf), (1,)).withColumn("lag_1", F.col("lag_1").cast("double"))
    return c.fill_null(lagged, ["lag_1"], 0.0)


@add("format_indian")
def _(spark, sf):
    base = states(spark, sf).withColumn("big", F.col("total") * 250).withColumn("small", F.col("total") % 1000)
    out = {}
    for name in ("total", "big", "small"):
        out[f"{name}_short"] = text.format_indian(F.col(name))
        out[f"{name}_wide"] = text.format_indian(F.col(name), 2, spaced=True)
    return base.withColumns(out)


@add("label_truncate")
def _(spark, sf):
    return districts(spark, sf).select(
        "district", *[text.truncate_label(F.col("district"), n).alias(f"first_{n}") for n in (3, 15, 20, 80)]
    )


@add("date_format")
def _(spark, sf):
    return daily(spark, sf).select(
        "date", *[calendar.format_date(F.col("date"), k).alias(k) for k in calendar.DATE_LAYOUTS]
    )


@add("milestone_label")
def _(spark, sf):
    scale = F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 10, 1000)])).alias("scale")
    rows = states(spark, sf).select("state", "total", scale)
    value = F.col("total") * F.col("scale")
    return rows.withColumn("milestone", value).withColumn("label", text.milestone_label(value))


@add("lower_bound_clip")
def _(spark, sf):
    mean = daily(spark, sf).agg(F.avg("value")).scalar()
    return daily(spark, sf).select("date", numeric.clip_lower(F.col("value") - mean).alias("above_mean"))


@add("rename_columns")
def _(spark, sf):
    wide = lines(spark, sf, "date", "state").groupBy("state").agg(F.sum("total"), F.min("date"), F.max("date"))
    return wide.toDF("state", "total_sum", "date_min", "date_max")


# --- profiling ---------------------------------------------------------------

@add("missing_profile")
def _(spark, sf):
    return p.missing_profile(c.validate_pincode(c.normalize_names(c.parse_date(tables.dirty_orders(spark, sf)))))


@add("duplicate_profile")
def _(spark, sf):
    return p.duplicate_profile(tables.dirty_orders(spark, sf))


@add("shape_schema")
def _(spark, sf):
    return p.shape_schema(records(spark, sf))


@add("describe_fractions")
def _(spark, sf):
    return p.describe_numeric(tables.table(spark, sf, "events"), columns=["value"])


@add("quantile_small_fractions")
def _(spark, sf):
    """Values below 0.002, scaled up again for rounding."""
    shares = tables.table(spark, sf, "events").select("event_type", (F.col("value") / 1e6).alias("share"))
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    found = quantile.exact_quantiles(shares, ["share"], probs, ["event_type"])
    return found.withColumns({p: F.col(p) * 1e6 for p in probs})


@add("describe_numeric")
def _(spark, sf):
    return p.describe_numeric(records(spark, sf), A)


@add("coverage_summary")
def _(spark, sf):
    return p.coverage_summary(records(spark, sf), A)


@add("histogram50")
def _(spark, sf):
    return p.equal_width_histogram(records(spark, sf), A)


@add("histogram20_utilization")
def _(spark, sf):
    from ..operators import kpi

    used = kpi.capacity_utilization(lines(spark, sf, "date", "state", "district"), A)
    return p.equal_width_histogram(used, A, 20, ["avg_utilization"])


@add("boxplot_stats")
def _(spark, sf):
    return p.boxplot_stats(records(spark, sf), A, A.measures)


@add("boxplot_by_state")
def _(spark, sf):
    return p.boxplot_by_state(records(spark, sf), A)


@add("correlation_matrix")
def _(spark, sf):
    return p.correlation_matrix(records(spark, sf), A)


@add("correlation_lower_triangle")
def _(spark, sf):
    return p.correlation_matrix(records(spark, sf), A, lower_triangle=True)


@add("pairwise_correlation")
def _(spark, sf):
    return p.pairwise_correlation(records(spark, sf), A)


@add("sample_rows")
def _(spark, sf):
    return p.sample_rows(records(spark, sf), ["date", "pincode"], 5000)


@add("value_counts")
def _(spark, sf):
    return p.value_counts(records(spark, sf), "state")


# --- aggregation -------------------------------------------------------------

@add("daily_total")
def _(spark, sf):
    return daily(spark, sf)


@add("daily_total_by_part")
def _(spark, sf):
    return g.daily_total(lines(spark, sf), A, "part_a")


@add("monthly_total")
def _(spark, sf):
    return g.monthly_total(lines(spark, sf), A)


@add("weekly_total")
def _(spark, sf):
    return g.weekly_total(lines(spark, sf), A)


@add("resample_weekly")
def _(spark, sf):
    return g.resample_weekly(lines(spark, sf), A)


@add("resample_monthly")
def _(spark, sf):
    return g.resample_monthly(lines(spark, sf), A)


@add("state_total")
def _(spark, sf):
    return states(spark, sf)


@add("district_total")
def _(spark, sf):
    return districts(spark, sf)


@add("district_total_by_name")
def _(spark, sf):
    return g.district_total(tables.segment_lines(spark, sf, ("district",)), A, qualified=False)


@add("pincode_total")
def _(spark, sf):
    return g.pincode_total(lines(spark, sf, "pincode"), A)


@add("age_group_totals")
def _(spark, sf):
    return g.part_totals(lines(spark, sf), A)


@add("monthly_age_totals")
def _(spark, sf):
    return g.monthly_part_totals(lines(spark, sf), A)


@add("weekday_total")
def _(spark, sf):
    return g.weekday_total(lines(spark, sf), A)


@add("weekday_total_filled")
def _(spark, sf):
    return g.weekday_total(lines(spark, sf), A, fill=0)


@add("weekday_mean")
def _(spark, sf):
    return g.weekday_mean(records(spark, sf), A)


@add("month_name_total")
def _(spark, sf):
    return g.month_name_total(lines(spark, sf), A)


@add("quarter_total")
def _(spark, sf):
    return g.quarter_total(lines(spark, sf), A)


@add("state_age_totals")
def _(spark, sf):
    return g.state_part_totals(lines(spark, sf, "state"), A)


@add("state_age_totals_nested")
def _(spark, sf):
    return g.state_part_totals(lines(spark, sf, "state"), A, 8)


@add("geo_profile")
def _(spark, sf):
    return g.geo_profile(lines(spark, sf, "date", "state", "pincode"), A)


@add("geo_profile_district")
def _(spark, sf):
    return g.geo_profile(tables.segment_lines(spark, sf, ("date", "pincode")), A, "district")


@add("pincode_profile")
def _(spark, sf):
    return g.pincode_profile(lines(spark, sf, "date", "state", "district", "pincode"), A)


@add("district_features")
def _(spark, sf):
    return g.region_features(lines(spark, sf, "date", "state", "district", "pincode"), A)


@add("state_features")
def _(spark, sf):
    return g.region_features(lines(spark, sf, "date", "state", "district", "pincode"), A, "state")


@add("district_volatility")
def _(spark, sf):
    return g.district_volatility(records(spark, sf), A)


@add("district_lifespan")
def _(spark, sf):
    return g.district_lifespan(lines(spark, sf, "date", "state", "district"), A)


@add("first_value_agg")
def _(spark, sf):
    return g.daily_with_calendar(lines(spark, sf), A)


@add("pivot_weekday_month_sum")
def _(spark, sf):
    return g.pivot_weekday_month(lines(spark, sf), A)


@add("pivot_peak_cell")
def _(spark, sf):
    return g.peak_cell(lines(spark, sf), A)


@add("pivot_weekday_month_mean")
def _(spark, sf):
    return g.pivot_weekday_month(records(spark, sf), A, "mean")


@add("pivot_state_month")
def _(spark, sf):
    return g.pivot_state_month(lines(spark, sf, "date", "state"), A)


@add("hierarchy_rollup")
def _(spark, sf):
    return g.hierarchy_rollup(lines(spark, sf, "state", "district"), A)


@add("hierarchy_rollup_drill")
def _(spark, sf):
    return g.hierarchy_rollup(lines(spark, sf, "state", "district", "pincode"), A, "NATION_7")


@add("quantile_linear")
def _(spark, sf):
    probs = {"q25": 0.25, "q75": 0.75, "q90": 0.9, "q95": 0.95}
    return g.quantile_linear(daily(spark, sf), "value", probs)


@add("quantile_linear_records")
def _(spark, sf):
    from ..operators.quantile import exact_quantiles

    probs = {"q25": 0.25, "q75": 0.75, "q90": 0.9, "q95": 0.95}
    return exact_quantiles(records(spark, sf), A.measures, probs, ["state"])


@add("argmax_argmin")
def _(spark, sf):
    return g.argmax_argmin(states(spark, sf), "total", "state")


@add("daily_stats")
def _(spark, sf):
    return g.daily_stats(daily(spark, sf))


@add("gini")
def _(spark, sf):
    return g.gini(states(spark, sf), "total")


@add("top_share")
def _(spark, sf):
    return g.top_share(states(spark, sf), "total")
