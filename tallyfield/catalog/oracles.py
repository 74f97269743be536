"""DuckDB SQL with the same result as each registered query."""

from __future__ import annotations

from .oracle_base import (
    CTES, SHARES, calendar, count, flags, isum, null_token, number, oracle as o, strip, title,
)

W7 = "ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW"
PARTS = ("part_a", "part_b", "part_c")
MEASURES = (*PARTS, "total")
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
_DAYS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(WEEKDAYS))
_DIM = f"(VALUES {_DAYS}) AS w(day_of_week, day_name)"


def _months(agg: str) -> str:
    return ", ".join(
        f"{agg.format(f'CASE WHEN month(date) = {i} THEN total END')} AS {m}"
        for i, m in enumerate(MONTHS, 1)
    )


def _indian(c: str, digits: int, gap: str) -> str:
    def part(d: str, suffix: str) -> str:
        return f"printf('%.{digits}f', {c} / {d}) || '{gap}{suffix}'"

    return (
        f"CASE WHEN {c} >= 1e7 THEN {part('1e7', 'Cr')} WHEN {c} >= 1e5 THEN {part('1e5', 'L')} "
        f"WHEN {c} >= 1e3 THEN {part('1e3', 'K')} ELSE printf('%.0f', CAST({c} AS DOUBLE)) END"
    )


def _histogram(source: str, bins: int) -> str:
    """Equal-width bins of (measure, value) rows."""
    return (
        f"SELECT l.measure, CAST(b AS INTEGER) AS bin, lo + (hi - lo) / {bins} * (b - 1) AS lower, "
        f"lo + (hi - lo) / {bins} * b AS upper, coalesce(c.n, 0) AS rows, mean, median FROM ("
        "SELECT measure, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi, "
        f"avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM {source} GROUP BY 1) l "
        f"CROSS JOIN range(1, {bins} + 1) AS r(b) LEFT JOIN (SELECT x.measure, "
        f"least(floor((value - lo) * {bins} / (hi - lo)) + 1, {bins}) AS bin, count(*) AS n FROM {source} x "
        "JOIN (SELECT measure, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi "
        f"FROM {source} GROUP BY 1) m ON x.measure = m.measure GROUP BY 1, 2) c "
        "ON c.measure = l.measure AND c.bin = b"
    )


def _box(source: str, key: str) -> str:
    return (
        f"SELECT x.{key}, q.n AS count, q1, median, q3, "
        "least(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), q1) AS whisker_low, "
        "greatest(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), q3) AS whisker_high, "
        "count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers, "
        "median - 1.57 * (q3 - q1) / sqrt(q.n) AS notch_low, median + 1.57 * (q3 - q1) / sqrt(q.n) AS notch_high "
        f"FROM {source} x JOIN (SELECT {key}, count(*) AS n, quantile_cont(value, 0.25) AS q1, "
        f"quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM {source} GROUP BY 1) q "
        f"ON x.{key} = q.{key} GROUP BY x.{key}, q.n, q1, median, q3"
    )


BOX_DOUBLES = "q1 median q3 whisker_low whisker_high notch_low notch_high"


def _corr(pairs: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS measure_a, '{b}' AS measure_b, "
        f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) AS r FROM activity"
        for a, b in pairs
    )


def _lower(columns: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[:i]]


SPLIT = "SELECT *, row_number() OVER (ORDER BY date) <= floor(count(*) OVER () * 0.8) AS is_train FROM demand"

CLEAN_COLUMNS = "date, state, district, pincode, age_0_5, age_5_17, age_18_greater"

SQL: dict[str, str] = {}

# --- sources and sinks -------------------------------------------------------
_zflag = (
    "(abs(z_score) > 3.0) AS is_anomaly, CASE WHEN z_score > 3.0 THEN 'High' WHEN z_score < -3.0 THEN 'Low' "
    "ELSE 'Normal' END AS anomaly_type"
)
_zfound = f"SELECT date, value, z_score, {_zflag}, round((value - m) / m * 100, 2) AS deviation_pct FROM zs WHERE abs(z_score) > 3.0"
SQL.update({
    "read_raw_csv": o("SELECT * FROM dirty_csv"),
    "read_clean": o("SELECT * FROM cleaned"),
    "materialize_if_absent": o("SELECT * FROM cleaned"),
    "raw_fallback_scan": o("SELECT * FROM raw_minimum"),
    "raw_fallback_totals": o(" UNION ALL ".join(
        f"SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS key, CAST(sum(total_enrollments) AS BIGINT) AS value "
        f"FROM raw_minimum WHERE {column} IS NOT NULL GROUP BY 2"
        for kind, key, column in (
            ("month", "CAST(date_trunc('month', date) AS DATE)", "date"), ("week", "CAST(date_trunc('week', date) AS DATE)", "date"),
            ("month name", "monthname(date)", "date"), ("state", "state", "state"),
        )
    )),
    "memoized_scan": o("SELECT * FROM states"),
    "write_report_csv": o("SELECT * FROM states"),
    "write_if_nonempty": o(
        f"SELECT * EXCLUDE (z_score), false AS wrote_empty, true AS wrote FROM ({_zfound})", "deviation_pct"
    ),
    "read_report": o("SELECT *, true AS missing_is_skipped FROM districts"),
    "export_filtered": o(
        "SELECT * FROM activity WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' "
        "AND state IN ('NATION_1', 'NATION_7') AND total BETWEEN 10 AND 40"
    ),
})

# --- cleaning ----------------------------------------------------------------
_parsed = "CAST(try_strptime(date, '%d-%m-%Y') AS DATE)"
SQL.update({
    "parse_date": o(f"SELECT date AS raw_date, {_parsed} AS date, count(*) AS n FROM dirty GROUP BY 1, 2"),
    "invalid_date_count": o(f"SELECT count(*) FILTER (WHERE {_parsed} IS NULL) AS invalid_dates FROM dirty"),
    "calendar_columns": o(f"SELECT date, value, {calendar('date')} FROM daily"),
    "weekend_month_edge_flags": o(f"SELECT date, value, {flags('date')} FROM daily"),
    "normalize_text": o("SELECT DISTINCT raw_state, raw_district, state, district FROM names"),
    "normalize_text_strict": o(
        f"SELECT {null_token('state')} AS state, count(*) AS n FROM names GROUP BY 1"
    ),
    "null_tokens": o(
        "SELECT count(*) FILTER (WHERE s IS NULL) AS missing, count(s) AS present FROM (SELECT "
        f"{null_token('t')} AS s FROM (SELECT {title('state')} AS t FROM dirty))"
    ),
    "validate_pincode": o("SELECT pincode, count(*) AS n FROM names GROUP BY 1"),
    "pincode_report": o(
        "SELECT count(*) FILTER (WHERE pincode IS NULL) AS invalid_pincodes, "
        "count(DISTINCT pincode) AS unique_valid_pincodes FROM names"
    ),
    "coerce_counts": o(
        f"SELECT raw_count, age_0_5, count(*) AS n, {isum('age_18_greater')} AS sum_c FROM names GROUP BY 1, 2"
    ),
    "counts_report": o(
        " UNION ALL ".join(
            f"SELECT '{c}' AS measure, count(*) FILTER (WHERE ({number(c)}) < 0) AS negatives, "
            f"min({count(c)}) AS min, max({count(c)}) AS max, avg({count(c)}) AS mean FROM dirty"
            for c in ("age_0_5", "age_5_17", "age_18_greater")
        ), "mean",
    ),
    "row_total": o(
        "SELECT age_0_5 + age_5_17 + age_18_greater AS total_enrollments, count(*) AS n FROM names GROUP BY 1"
    ),
    "drop_exact_duplicates": o("SELECT DISTINCT * FROM dirty"),
    "drop_missing_critical": o(
        f"SELECT {_parsed} AS date, n.state, n.district, pincode, age_0_5, age_5_17, age_18_greater FROM ("
        "SELECT * REPLACE (" + strip("regexp_replace(state, '[*?#@!]', '', 'g')") + " AS state, "
        + strip("regexp_replace(district, '[*?#@!]', '', 'g')") + " AS district) FROM nulled) n "
        f"WHERE {_parsed} IS NOT NULL AND n.state IS NOT NULL AND n.district IS NOT NULL"
    ),
    "clean_pipeline": o("SELECT * FROM cleaned"),
    "drop_numeric_names": o("SELECT * FROM states WHERE state NOT IN ('NATION_3', 'NATION_4', 'NATION_5')"),
    "share_columns": o(f"SELECT *, {SHARES} FROM activity", "pct_a pct_b pct_c"),
    "per_unit_averages": o(
        "SELECT *, total * 1.0 / active_days AS per_day, total * 1.0 / unique_pincodes AS per_pincode FROM geo",
        "per_day per_pincode",
    ),
    "label_encode": o(
        "SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS state_encoded, label, total FROM ("
        "SELECT CASE WHEN state = 'NATION_9' THEN 'Unknown' ELSE state END AS label, total FROM states)"
    ),
    "fill_null": o("SELECT date, value, coalesce(CAST(lag(value) OVER (ORDER BY date) AS DOUBLE), 0) AS lag_1 FROM daily"),
    "format_indian": o(
        "SELECT state, total, big, small, " + ", ".join(
            f"{_indian(c, 1, '')} AS {c}_short, {_indian(c, 2, ' ')} AS {c}_wide" for c in ("total", "big", "small")
        ) + " FROM (SELECT state, total, total * 250 AS big, total % 1000 AS small FROM states)"
    ),
    "label_truncate": o(
        "SELECT district, " + ", ".join(f"substr(district, 1, {n}) AS first_{n}" for n in (3, 15, 20, 80)) + " FROM districts"
    ),
    "date_format": o(
        "SELECT date, strftime(date, '%Y-%m-%d') AS iso, strftime(date, '%d-%m-%Y') AS day_first, "
        "strftime(date, '%d %b %Y') AS short_month, strftime(date, '%b %Y') AS month_year FROM daily"
    ),
    "milestone_label": o(
        "SELECT state, total, scale, total * scale AS milestone, CASE WHEN total * scale >= 1000000 "
        "THEN printf('%.0fM', total * scale / 1e6) ELSE printf('%.0fK', total * scale / 1e3) END AS label "
        "FROM states CROSS JOIN (VALUES (CAST(1 AS BIGINT)), (10), (1000)) AS v(scale)"
    ),
    "lower_bound_clip": o(
        "SELECT date, greatest(0.0, value - (SELECT avg(value) FROM daily)) AS above_mean FROM daily", "above_mean"
    ),
    "rename_columns": o(
        f"SELECT state, {isum('total')} AS total_sum, min(date) AS date_min, max(date) AS date_max FROM activity GROUP BY 1"
    ),
})

# --- profiling ---------------------------------------------------------------
_all_columns = tuple(CLEAN_COLUMNS.split(", "))
SQL.update({
    "missing_profile": o(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, "
            f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS missing_pct FROM "
            + ("dirty" if c.startswith("age") else "names")
            for c in _all_columns
        ), "missing_pct",
    ),
    "duplicate_profile": o(
        "SELECT a - b AS duplicates, round((a - b) * 100.0 / a, 2) AS duplicate_pct FROM (SELECT "
        "(SELECT count(*) FROM dirty) AS a, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS b)", "duplicate_pct",
    ),
    "shape_schema": o(
        "SELECT (SELECT count(*) FROM activity) AS rows, 8 AS columns, position, \"column\", type FROM (VALUES "
        "(1, 'date', 'date'), (2, 'state', 'string'), (3, 'district', 'string'), (4, 'pincode', 'string'), "
        "(5, 'part_a', 'bigint'), (6, 'part_b', 'bigint'), (7, 'part_c', 'bigint'), (8, 'total', 'bigint')) "
        "AS v(position, \"column\", type)"
    ),
    "describe_numeric": o(
        "SELECT measure, count(*) AS count, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, "
        "min(value) AS min, round(quantile_cont(value, 0.25), 2) AS p25, round(quantile_cont(value, 0.5), 2) AS p50, "
        "round(quantile_cont(value, 0.75), 2) AS p75, max(value) AS max FROM long GROUP BY 1", "mean std p25 p50 p75",
    ),
    "describe_fractions": o(
        "SELECT 'value' AS measure, count(value) AS count, round(avg(value), 2) AS mean, round(stddev_samp(value), 2) AS std, "
        "min(value) AS min, round(quantile_cont(value, 0.25), 2) AS p25, round(quantile_cont(value, 0.5), 2) AS p50, "
        "round(quantile_cont(value, 0.75), 2) AS p75, max(value) AS max FROM events", "mean std min p25 p50 p75 max",
    ),
    "quantile_small_fractions": o(
        "SELECT event_type, 'share' AS measure, " + ", ".join(
            f"quantile_cont(value / 1e6, {p}) * 1e6 AS {n}" for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))
        ) + " FROM events GROUP BY 1", "p10 p50 p90",
    ),
    "sample_rows": o("SELECT * FROM activity ORDER BY md5('42|' || CAST(date AS VARCHAR) || '|' || pincode), date, pincode LIMIT 5000"),
    "coverage_summary": o(
        "SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT state) AS states, "
        "count(DISTINCT district) AS districts, count(DISTINCT pincode) AS pincodes, count(*) AS records, "
        + ", ".join(f"{isum(c)} AS sum_{c}" for c in MEASURES) + " FROM activity"
    ),
    "histogram50": o(_histogram("long", 50), "lower upper mean median"),
    "histogram20_utilization": o(
        "SELECT * FROM (" + _histogram(
            "(SELECT 'avg_utilization' AS measure, avg(t) * 100 / 500.0 AS value FROM (SELECT district, date, "
            "sum(total) AS t FROM activity GROUP BY 1, 2) GROUP BY district)", 20
        ) + ")", "lower upper mean median",
    ),
    "boxplot_stats": o(_box("long", "measure"), BOX_DOUBLES),
    "boxplot_by_state": o(
        _box("(SELECT state, total AS value FROM activity WHERE state IN (SELECT state FROM states "
             "ORDER BY total DESC, state LIMIT 10))", "state"), BOX_DOUBLES,
    ),
    "correlation_matrix": o(_corr([(a, b) for a in MEASURES for b in MEASURES]), "r"),
    "correlation_lower_triangle": o(_corr(_lower(MEASURES)), "r"),
    "pairwise_correlation": o(_corr(_lower(PARTS)), "r"),
    "value_counts": o("SELECT state, count(*) AS count FROM activity GROUP BY 1"),
})

# --- aggregation -------------------------------------------------------------
_dow_totals = f"(SELECT isodow(date) - 1 AS d, {isum('total')} AS value FROM activity GROUP BY 1)"
_leaf = "districts"
_drill = f"(SELECT state, district, pincode, {isum('total')} AS total FROM activity WHERE state = 'NATION_7' GROUP BY 1, 2, 3)"
_quants = ", ".join(f"quantile_cont({{0}}, {p}) AS q{int(p * 100)}" for p in (0.25, 0.75, 0.9, 0.95))


def _state_parts(n: int) -> str:
    return o(
        f"SELECT *, {SHARES} FROM (SELECT state, " + ", ".join(f"{isum(c)} AS {c}" for c in MEASURES)
        + f" FROM activity GROUP BY 1 ORDER BY total DESC, state LIMIT {n})", "pct_a pct_b pct_c",
    )


_volume_state = (
    f"SELECT *, {SHARES}, total * 1.0 / active_days AS daily_avg, total * 1.0 / unique_pincodes AS per_pincode_avg "
    f"FROM (SELECT state, {isum('total')} AS total, " + ", ".join(f"{isum(c)} AS {c}" for c in PARTS)
    + ", count(DISTINCT date) AS active_days, count(DISTINCT pincode) AS unique_pincodes FROM activity GROUP BY 1)"
)
SQL.update({
    "daily_total": o("SELECT * FROM daily"),
    "daily_total_by_part": o(f"SELECT date, {isum('part_a')} AS value FROM activity GROUP BY 1"),
    "monthly_total": o("SELECT * FROM monthly"),
    "weekly_total": o("SELECT * FROM weekly"),
    "resample_weekly": o(
        "SELECT CAST(w + INTERVAL 6 DAY AS DATE) AS date, CAST(coalesce(sum(total), 0) AS BIGINT) AS value FROM ("
        "SELECT unnest(generate_series(date_trunc('week', min(date)), date_trunc('week', max(date)), INTERVAL 7 DAY)) "
        "AS w FROM activity) LEFT JOIN activity ON date_trunc('week', date) = w GROUP BY 1"
    ),
    "resample_monthly": o(
        "SELECT last_day(CAST(w AS DATE)) AS date, CAST(coalesce(sum(total), 0) AS BIGINT) AS value FROM ("
        "SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) "
        "AS w FROM activity) LEFT JOIN activity ON date_trunc('month', date) = w GROUP BY 1"
    ),
    "state_total": o("SELECT * FROM states"),
    "district_total": o("SELECT * FROM districts"),
    "district_total_by_name": o(f"SELECT district, {isum('total')} AS total FROM segments GROUP BY 1"),
    "pincode_total": o(f"SELECT pincode, {isum('total')} AS total FROM activity GROUP BY 1"),
    "age_group_totals": o(
        " UNION ALL ".join(
            f"SELECT '{c}' AS part, {isum(c)} AS value, sum({c}) * 100.0 / sum(total) AS share_pct FROM activity"
            for c in PARTS
        ), "share_pct",
    ),
    "monthly_age_totals": o(
        "SELECT CAST(date_trunc('month', date) AS DATE) AS month, " + ", ".join(f"{isum(c)} AS {c}" for c in PARTS)
        + " FROM activity GROUP BY 1"
    ),
    "weekday_total": o(
        f"SELECT day_of_week, day_name, value, value > avg(value) OVER () AS above_average FROM {_DIM} "
        f"LEFT JOIN {_dow_totals} ON d = day_of_week"
    ),
    "weekday_total_filled": o(
        "SELECT *, value > avg(value) OVER () AS above_average FROM (SELECT day_of_week, day_name, "
        f"coalesce(value, 0) AS value FROM {_DIM} LEFT JOIN {_dow_totals} ON d = day_of_week)"
    ),
    "weekday_mean": o("SELECT dayname(date) AS day_name, avg(total) AS mean FROM activity GROUP BY 1", "mean"),
    "month_name_total": o(
        f"SELECT CAST(month(date) AS INTEGER) AS month, monthname(date) AS month_name, {isum('total')} AS value "
        "FROM activity GROUP BY 1, 2"
    ),
    "quarter_total": o(
        "SELECT quarter, value, row_number() OVER (ORDER BY value DESC, quarter) = 1 AS is_best, "
        "row_number() OVER (ORDER BY value, quarter) = 1 AS is_worst FROM (SELECT CAST(quarter(date) AS INTEGER) "
        f"AS quarter, {isum('value')} AS value FROM daily GROUP BY 1)"
    ),
    "state_age_totals": _state_parts(10),
    "state_age_totals_nested": _state_parts(8),
    "geo_profile": o("SELECT * FROM geo"),
    "geo_profile_district": o("SELECT * FROM geodist"),
    "pincode_profile": o("SELECT * FROM pins"),
    "district_features": o("SELECT * FROM features", "pct_a pct_b pct_c daily_avg per_pincode_avg"),
    "state_features": o(_volume_state, "pct_a pct_b pct_c daily_avg per_pincode_avg"),
    "district_volatility": o("SELECT * FROM vol", "daily_mean daily_std"),
    "district_lifespan": o(
        "SELECT *, total * 1.0 / days AS daily_avg, children * 100.0 / total AS children_pct FROM (SELECT state, district, "
        f"{isum('total')} AS total, {isum('part_a')} AS children, min(date) AS start, max(date) AS \"end\", "
        "count(DISTINCT date) AS days FROM activity GROUP BY 1, 2) WHERE days > 7", "daily_avg children_pct",
    ),
    "first_value_agg": o("SELECT * FROM daycal"),
    "pivot_weekday_month_sum": o(
        f"SELECT day_of_week, day_name, {', '.join(MONTHS)} FROM {_DIM} LEFT JOIN (SELECT isodow(date) - 1 AS d, "
        f"{_months('CAST(sum({}) AS BIGINT)')} FROM activity GROUP BY 1) ON d = day_of_week"
    ),
    "pivot_peak_cell": o(
        "SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, "
        f"{isum('total')} AS value FROM activity GROUP BY 1, 2 ORDER BY value DESC, 1, 2 LIMIT 1"
    ),
    "pivot_weekday_month_mean": o(
        f"SELECT day_of_week, day_name, {', '.join(MONTHS)} FROM {_DIM} LEFT JOIN (SELECT isodow(date) - 1 AS d, "
        f"{_months('avg({})')} FROM activity GROUP BY 1) ON d = day_of_week", " ".join(MONTHS),
    ),
    "pivot_state_month": o(
        f"SELECT state, {_months('CAST(sum({}) AS BIGINT)')}, {isum('total')} AS row_total FROM activity GROUP BY 1 "
        "ORDER BY row_total DESC, state LIMIT 15"
    ),
    "hierarchy_rollup": o(
        f"SELECT state, district, {isum('total')} AS total, CAST(2 - grouping(state) - grouping(district) AS INTEGER) "
        f"AS depth FROM {_leaf} GROUP BY ROLLUP (state, district)"
    ),
    "hierarchy_rollup_drill": o(
        f"SELECT state, district, pincode, {isum('total')} AS total, CAST(3 - grouping(state) - grouping(district) "
        f"- grouping(pincode) AS INTEGER) AS depth FROM {_drill} GROUP BY ROLLUP (state, district, pincode)"
    ),
    "quantile_linear": o(f"SELECT {_quants.format('value')} FROM daily", "q25 q75 q90 q95"),
    "quantile_linear_records": o(
        f"SELECT state, measure, {_quants.format('value')} FROM long GROUP BY 1, 2", "q25 q75 q90 q95"
    ),
    "argmax_argmin": o(
        "SELECT a.state AS max_key, a.total AS max_value, b.state AS min_key, b.total AS min_value FROM "
        "(SELECT * FROM states ORDER BY total DESC, state LIMIT 1) a, (SELECT * FROM states ORDER BY total, state LIMIT 1) b"
    ),
    "daily_stats": o(
        "SELECT avg(value) AS mean, median(value) AS median, max(value) AS max, min(value) AS min, "
        "stddev_samp(value) AS std FROM daily", "mean median std",
    ),
    "gini": o(
        "SELECT (2.0 * sum(i * total) - (count(*) + 1) * sum(total)) / (count(*) * sum(total)) AS gini FROM ("
        "SELECT total, row_number() OVER (ORDER BY total) AS i FROM states)", "gini",
    ),
    "top_share": o(
        "SELECT " + ", ".join(
            f"sum(CASE WHEN r <= {k} THEN total END) * 100.0 / sum(total) AS top_{k}_share" for k in (1, 3, 5, 10)
        ) + " FROM (SELECT total, row_number() OVER (ORDER BY total DESC) AS r FROM states)",
        "top_1_share top_3_share top_5_share top_10_share",
    ),
})

# --- ordered series ----------------------------------------------------------
_strict = ", ".join(
    f"CASE WHEN count(*) OVER w{w} = {w} THEN avg(value) OVER w{w} END AS mean_{w}" for w in (3, 7, 14)
)
_frames = ", ".join(
    f"w{w} AS (ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (3, 7, 14)
)
_growth = "(value - lag(value) OVER (ORDER BY month)) * 100.0 / lag(value) OVER (ORDER BY month)"
_cum = "(SELECT date, sum(value) OVER (ORDER BY date) AS c FROM daily)"
SQL.update({
    "zscore": o("SELECT date, value, z_score FROM zs", "z_score"),
    "rolling_mean": o(f"SELECT *, avg(value) OVER ({W7}) AS mean_7 FROM daily", "mean_7"),
    "rolling_mean_weekly": o(
        "SELECT *, avg(value) OVER (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean_4 FROM weekly", "mean_4"
    ),
    "rolling_mean_strict": o(f"SELECT *, {_strict} FROM daily WINDOW {_frames}", "mean_3 mean_7 mean_14"),
    "rolling_mean_strict_by_type": o(
        "SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS mean_7 FROM event_days "
        f"WINDOW w AS (PARTITION BY state {W7})", "mean_7",
    ),
    "rolling_std": o(f"SELECT *, stddev_samp(value) OVER ({W7}) AS std_7 FROM daily", "std_7"),
    "centered_mean": o(
        "SELECT *, avg(value) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM daily", "trend"
    ),
    "centered_mean_even": o(
        "SELECT *, avg(value) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS trend "
        "FROM event_days", "trend",
    ),
    "lag_features": o(
        "SELECT *, " + ", ".join(f"lag(value, {i}) OVER (ORDER BY date) AS lag_{i}" for i in (1, 7, 14)) + " FROM daily"
    ),
    "cumulative_sum": o("SELECT *, CAST(sum(value) OVER (ORDER BY date) AS BIGINT) AS cumulative FROM daily"),
    "pct_change": o(f"SELECT *, {_growth} AS growth_pct FROM monthly", "growth_pct"),
    "growth_summary": o(
        "SELECT avg(g) AS avg_growth, max(g) AS max_growth, min(g) AS min_growth FROM "
        f"(SELECT {_growth} AS g FROM monthly)", "avg_growth max_growth min_growth",
    ),
    "month_diff_waterfall": o(
        "SELECT month, start, value AS \"end\", value - start AS change, least(start, value) AS bottom, "
        "abs(value - start) AS height FROM (SELECT *, lag(value) OVER (ORDER BY month) AS start FROM monthly) "
        "WHERE start IS NOT NULL"
    ),
    "run_ids": o(
        "SELECT date, value, above, CAST(sum(CASE WHEN above IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) "
        "OVER (ORDER BY date) AS BIGINT) AS run_id FROM (SELECT *, lag(above) OVER (ORDER BY date) AS prev FROM ("
        "SELECT *, value > (SELECT avg(value) FROM daily) AS above FROM daily))"
    ),
    "percentile_rank_avg": o(
        "SELECT pincode, total, (rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0) "
        f"/ count(*) OVER () * 100 AS percentile FROM (SELECT pincode, {isum('total')} AS total FROM activity GROUP BY 1)",
        "percentile",
    ),
    "rank_first_tercile": o(
        "SELECT state, district, total, score, CASE least(2, floor(3 * (r - 1) / (n - 1))) WHEN 0 THEN 'Low Risk' "
        "WHEN 1 THEN 'Medium Risk' ELSE 'High Risk' END AS category FROM (SELECT *, row_number() OVER "
        "(ORDER BY score, state, district) AS r, count(*) OVER () AS n FROM (SELECT *, "
        "CAST(floor(total / 1000) AS BIGINT) AS score FROM districts))"
    ),
    "cumulative_share": o(
        "SELECT state, total, position, cumulative_pct, CAST(min(CASE WHEN cumulative_pct >= 80 THEN position END) "
        "OVER () AS INTEGER) AS reached_at FROM (SELECT state, total, CAST(row_number() OVER w AS INTEGER) AS position, "
        "sum(total) OVER w * 100.0 / sum(total) OVER () AS cumulative_pct FROM states "
        "WINDOW w AS (ORDER BY total DESC, state ROWS UNBOUNDED PRECEDING))", "cumulative_pct",
    ),
    "threshold_crossing": o(
        f"SELECT milestone, min(date) AS date FROM {_cum}, (VALUES (CAST(100000 AS BIGINT)), (500000), (1000000), "
        "(5000000000)) AS v(milestone) WHERE c >= milestone GROUP BY 1"
    ),
    "minmax_scale": o(
        "SELECT *, (total - min(total) OVER ()) * 1.0 / (max(total) OVER () - min(total) OVER ()) AS scaled FROM districts",
        "scaled",
    ),
    "max_scale": o("SELECT *, total * 100.0 / max(total) OVER () AS scaled FROM districts", "scaled"),
    "cap_at_quantile": o(
        "SELECT *, least(total, (SELECT quantile_cont(total, 0.95) FROM districts)) AS capped FROM districts", "capped"
    ),
    "tail_mean": o(
        "SELECT avg(value) AS tail_mean, count(*) AS rows FROM (SELECT value FROM daily ORDER BY date DESC LIMIT 30)",
        "tail_mean",
    ),
})

# --- joins -------------------------------------------------------------------
SQL.update({
    "semi_top_states": o(
        "SELECT * FROM activity WHERE state IN (SELECT state FROM states ORDER BY total DESC, state LIMIT 5)"
    ),
    "lookup_weekday_mean": o(
        "SELECT *, avg(value) OVER (PARTITION BY isodow(date)) AS weekday_mean FROM daily", "weekday_mean"
    ),
    "holiday_lookup": o("SELECT d.date, d.value, h.holiday FROM daily d JOIN holidays h ON d.date = h.date"),
    "holiday_anti": o("SELECT * FROM daily WHERE date NOT IN (SELECT date FROM holidays)"),
    "interval_neighbors": o(
        "SELECT h.date AS anchor, CAST(d.date - h.date AS INTEGER) AS \"offset\", d.date, d.value FROM holidays h JOIN daily d "
        "ON d.date BETWEEN h.date - 3 AND h.date + 3 AND d.date <> h.date"
    ),
    "scalar_broadcast": o(
        "SELECT d.*, mean, std, q90 FROM districts d, (SELECT avg(total) AS mean, stddev_samp(total) AS std, "
        "quantile_cont(total, 0.9) AS q90 FROM districts)", "mean std q90",
    ),
    "cluster_name_lookup": o(
        "SELECT p.state, p.district, p.cluster, n.cluster_name FROM placed p JOIN named n ON p.cluster = n.cluster"
    ),
    "dimension_reindex": o(
        f"SELECT CAST(day_of_week AS INTEGER) AS position, day_name, value FROM {_DIM} LEFT JOIN (SELECT dayname(date) AS n, "
        f"{isum('value')} AS value FROM daily GROUP BY 1) ON n = day_name"
    ),
})

# --- filters, top-k ----------------------------------------------------------
_perform = (
    "(SELECT state, total, p AS units_per_day, (p - avg(p) OVER ()) / stddev_samp(p) OVER () AS z FROM "
    "(SELECT *, total * 1.0 / active_days AS p FROM geo))"
)
SQL.update({
    "filter_date_range": o("SELECT * FROM activity WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'"),
    "filter_states": o("SELECT * FROM activity WHERE state IN ('NATION_2', 'NATION_11')"),
    "filter_states_none": o("SELECT * FROM states"),
    "filter_value_range": o("SELECT * FROM activity WHERE total BETWEEN 45 AND 60"),
    "filter_drill_state": o("SELECT * FROM activity WHERE state = 'NATION_7'"),
    "sort_recent_first": o("SELECT * FROM activity ORDER BY date DESC"),
    "top_states": o("SELECT * FROM states ORDER BY total DESC, state LIMIT 10"),
    "top_districts": o("SELECT * FROM districts ORDER BY total DESC, state, district LIMIT 20"),
    "bottom_districts": o("SELECT * FROM districts ORDER BY total, state, district LIMIT 10"),
    "top_pincodes": o(
        f"SELECT pincode, {isum('total')} AS total FROM activity GROUP BY 1 ORDER BY total DESC, pincode LIMIT 20"
    ),
    "top_with_others": o(
        "SELECT CASE WHEN r <= 8 THEN state ELSE 'Others' END AS state, CAST(sum(total) AS BIGINT) AS total, "
        "sum(total) * 100.0 / (SELECT sum(total) FROM states) AS pct FROM (SELECT *, row_number() OVER "
        "(ORDER BY total DESC, state) AS r FROM states) GROUP BY 1", "pct",
    ),
    "top_bottom_pincodes": o(
        "SELECT *, 'top' AS side FROM (SELECT * FROM pinscores ORDER BY total DESC, pincode, state, district LIMIT 20) "
        "UNION ALL SELECT *, 'bottom' AS side FROM (SELECT * FROM pinscores ORDER BY total, pincode, state, district LIMIT 20)",
        "daily_avg percentile",
    ),
    "filter_min_history": o(
        "SELECT pincode, count(DISTINCT date) AS points FROM activity GROUP BY 1 HAVING count(DISTINCT date) > 40"
    ),
    "union_shards": o(
        "SELECT n_name AS state, CAST(sum(l_quantity) AS BIGINT) AS total, "
        "count(CASE WHEN year(l_shipdate) >= 1999 THEN 1 END) AS with_part FROM lineitem JOIN orders "
        "ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"
    ),
    "top_performers": o(
        f"SELECT state, total, units_per_day, CASE WHEN z > 1 THEN 'high' ELSE 'low' END AS side FROM {_perform} "
        "WHERE z > 1 OR z < -1", "units_per_day",
    ),
    "top_high_risk": o(
        "SELECT * FROM risk WHERE risk_category = 'High Risk' ORDER BY risk_score DESC, state, district LIMIT 15",
        "daily_mean daily_std cv cv_normalized coverage volume_score risk_score",
    ),
    "distinct_sorted": o("SELECT state FROM states ORDER BY 1"),
    "date_bounds": o("SELECT min(date) AS first_date, max(date) AS last_date FROM daily"),
})

# --- anomalies ---------------------------------------------------------------
_iqrflag = (
    "(value > upper_bound OR value < lower_bound) AS is_anomaly, CASE WHEN value > upper_bound THEN 'High' "
    "WHEN value < lower_bound THEN 'Low' ELSE 'Normal' END AS anomaly_type"
)


def _deviation(thr: float) -> str:
    return (
        "SELECT *, CAST(sum(CASE WHEN is_deviant IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (ORDER BY date) AS BIGINT) "
        "AS run_id FROM (SELECT *, lag(is_deviant) OVER (ORDER BY date) AS prev FROM (SELECT *, "
        f"coalesce(abs(deviation) > {thr}, false) AS is_deviant FROM (SELECT *, (value - ma) / nullif(std, 0) AS deviation "
        f"FROM (SELECT *, avg(value) OVER w AS ma, stddev_samp(value) OVER w AS std FROM daily WINDOW w AS ({W7})))))"
    )


def _decompose(before: int, after: int) -> str:
    return (
        "SELECT date, value AS original, trend, seasonal, residual, "
        "abs(residual - avg(residual) OVER ()) > 2.5 * stddev_samp(residual) OVER () AS is_residual_anomaly FROM ("
        "SELECT *, value - trend - seasonal AS residual FROM (SELECT *, avg(value - trend) OVER (PARTITION BY isodow(date)) "
        "AS seasonal FROM (SELECT *, avg(value) OVER (ORDER BY date ROWS BETWEEN "
        f"{before} PRECEDING AND {after} FOLLOWING) AS trend FROM daily)))"
    )


def _geo(source: str, thr: float, where: str = "") -> str:
    return o(
        "SELECT *, units_per_day_zscore > {t} AS is_high_performer, units_per_day_zscore < -{t} AS is_low_performer, "
        "abs(units_per_day_zscore) > {t} AS is_anomaly FROM (SELECT *, "
        "(units_per_day - avg(units_per_day) OVER ()) / stddev_samp(units_per_day) OVER () AS units_per_day_zscore, "
        "(units_per_pincode - avg(units_per_pincode) OVER ()) / stddev_samp(units_per_pincode) OVER () "
        "AS units_per_pincode_zscore FROM (SELECT *, total * 1.0 / active_days AS units_per_day, "
        "total * 1.0 / unique_pincodes AS units_per_pincode FROM {s})) {w}".format(t=thr, s=source, w=where),
        "units_per_day units_per_pincode units_per_day_zscore units_per_pincode_zscore",
    )


_DECO = "trend seasonal residual"
SQL.update({
    "anomaly_zscore": o(_zfound, "z_score deviation_pct"),
    "anomaly_zscore_daily": o(f"SELECT date, value, z_score, {_zflag} FROM zs", "z_score"),
    "anomaly_zscore_by_state": o(
        f"SELECT state, date, value, z_score, {_zflag}, round((value - m) / m * 100, 2) AS deviation_pct FROM (SELECT *, "
        "(value - m) / sd AS z_score FROM (SELECT *, avg(value) OVER (PARTITION BY state) AS m, "
        "stddev_samp(value) OVER (PARTITION BY state) AS sd FROM state_days)) WHERE abs(z_score) > 3.0",
        "z_score deviation_pct",
    ),
    "anomaly_iqr": o(
        f"SELECT date, value, lower_bound, upper_bound, {_iqrflag} FROM iqr WHERE value > upper_bound OR value < lower_bound",
        "lower_bound upper_bound",
    ),
    "anomaly_iqr_daily": o(
        f"SELECT date, value, lower_bound, upper_bound, {_iqrflag} FROM iqr", "lower_bound upper_bound"
    ),
    "anomaly_runs": o(
        "SELECT run_id, min(date) AS start_date, max(date) AS end_date, count(*) AS duration, "
        f"avg(deviation) AS avg_deviation, avg(value) AS avg_value FROM ({_deviation(1.5)}) WHERE is_deviant "
        "GROUP BY 1 HAVING count(*) >= 2", "avg_deviation avg_value",
    ),
    "anomaly_runs_daily": o(f"SELECT * EXCLUDE (prev) FROM ({_deviation(2.0)})", "ma std deviation"),
    "seasonal_decompose": o(_decompose(3, 3), _DECO),
    "seasonal_decompose_30": o(f"SELECT * FROM ({_decompose(15, 14)}) WHERE is_residual_anomaly", _DECO),
    "anomaly_geo": _geo("geo", 2.0, "WHERE abs(units_per_day_zscore) > 2.0"),
    "anomaly_geo_scores": _geo("geo", 1.0),
    "anomaly_geo_district": _geo("geodist", 1.0),
    "anomaly_pincode": o("SELECT * FROM pinscores", "daily_avg percentile"),
    "holiday_impact": o(
        "SELECT *, CASE WHEN avg_after > avg_before * 0.9 THEN 1 ELSE 2 END AS recovery_days FROM impact",
        "baseline impact_pct avg_before avg_after",
    ),
    "holiday_baseline": o("SELECT avg(value) AS baseline FROM daily WHERE date NOT IN (SELECT date FROM holidays)", "baseline"),
    "holiday_mean_impact": o("SELECT avg(impact_pct) AS avg_impact, count(*) AS holidays FROM impact", "avg_impact"),
    "control_limits": o(
        "SELECT *, CASE WHEN value > ucl OR value < lcl THEN 'out_of_control' WHEN value > uwl OR value < lwl "
        "THEN 'warning' ELSE 'in_control' END AS zone FROM (SELECT date, value, mean, mean + 3 * std AS ucl, "
        "greatest(0, mean - 3 * std) AS lcl, mean + 2 * std AS uwl, greatest(0, mean - 2 * std) AS lwl FROM daily, "
        "(SELECT avg(value) AS mean, stddev_samp(value) AS std FROM daily))", "mean ucl lcl uwl lwl",
    ),
})

# --- forecasts ---------------------------------------------------------------
_BOUNDS = "forecast lower_bound upper_bound"


def _holt(source: str, periods: int, alpha: float, beta: float, key: str = "") -> str:
    """The recurrence as a recursive query over numbered days."""
    k, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    same = f" AND s.{key} = n.{key}" if key else ""
    one = f"n.{key}, " if key else ""
    level = f"({alpha} * n.value + (1 - {alpha}) * (s.level + s.trend))"
    return (
        f"SELECT {k}CAST(i AS INTEGER) AS step, date + CAST(i AS INTEGER) AS date, "
        "greatest(0, level + i * trend) AS forecast, greatest(0, level + i * trend) * 0.7 AS lower_bound, "
        f"greatest(0, level + i * trend) * 1.3 AS upper_bound FROM (SELECT * FROM fold WHERE t = len), range(1, {periods} + 1) AS r(i)"
    ), (
        f"numbered AS MATERIALIZED (SELECT *, row_number() OVER ({part}ORDER BY date) AS t, count(*) OVER ("
        f"{part}) AS len, lead(value) OVER ({part}ORDER BY date) AS nxt FROM {source}), "
        f"fold AS (SELECT {k}date, t, len, CAST(value AS DOUBLE) AS level, CAST(coalesce(nxt - value, 0) AS DOUBLE) AS trend "
        f"FROM numbered WHERE t = 1 UNION ALL SELECT {one}n.date, n.t, n.len, {level}, "
        f"{beta} * ({level} - s.level) + (1 - {beta}) * s.trend FROM fold s JOIN numbered n ON n.t = s.t + 1{same})"
    )


def _holt_sql(source: str, periods: int, alpha: float, beta: float, key: str = "") -> str:
    body, extra = _holt(source, periods, alpha, beta, key)
    base = o(f"SELECT * FROM {source}")
    head = base[: base.rindex(f" SELECT * FROM {source}")]
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in _BOUNDS.split())
    return f"{head}, {extra} SELECT * REPLACE ({cols}) FROM ({body})"


def _by_state() -> str:
    trended = (
        "SELECT *, value - trend AS detrended, row_number() OVER (PARTITION BY state ORDER BY date) - 1 AS pos, "
        "count(*) OVER (PARTITION BY state) AS n FROM (SELECT *, avg(value) OVER (PARTITION BY state ORDER BY date "
        "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM state_days WHERE state IN (SELECT state FROM states "
        "ORDER BY total DESC, state LIMIT 10))"
    )
    ends = (
        "SELECT state, max(date) AS last_date, max(CASE WHEN n - pos = 1 THEN trend END) AS tl, "
        "max(CASE WHEN n - pos = 7 THEN trend END) AS tp, stddev_pop(detrended) AS sigma "
        f"FROM ({trended}) WHERE n > 14 GROUP BY 1"
    )
    factors = (
        "SELECT state, slot, raw - avg(raw) OVER (PARTITION BY state) AS factor FROM (SELECT state, pos % 7 AS slot, "
        f"avg(detrended) AS raw FROM ({trended}) GROUP BY 1, 2)"
    )
    return o(
        "SELECT state, CAST(i AS INTEGER) AS step, last_date + CAST(i AS INTEGER) AS date, forecast, "
        "greatest(0, forecast - 1.96 * sigma) AS lower_bound, forecast + 1.96 * sigma AS upper_bound FROM (SELECT e.state, i, "
        f"last_date, sigma, greatest(0, tl + i * (tl - tp) / 7 + factor) AS forecast FROM ({ends}) e, range(1, 31) AS r(i), "
        f"({factors}) f WHERE f.state = e.state AND f.slot = (isodow(last_date) - 1 + i) % 7)", _BOUNDS,
    )


_weekday_phase = (
    "SELECT step, date, forecast, greatest(0, forecast - 1.96 * sigma) AS lower_bound, forecast + 1.96 * sigma AS upper_bound "
    "FROM (SELECT CAST(i AS INTEGER) AS step, last_date + CAST(i AS INTEGER) AS date, sigma, "
    "greatest(0, tl + i * (tl - tp) / 7 + factor) AS forecast FROM (SELECT max(date) AS last_date, "
    "max(CASE WHEN n - pos = 1 THEN trend END) AS tl, max(CASE WHEN n - pos = 7 THEN trend END) AS tp, "
    "stddev_pop(detrended) AS sigma FROM trended), range(1, 31) AS r(i), (SELECT slot, raw - avg(raw) OVER () AS factor FROM ("
    "SELECT isodow(date) - 1 AS slot, avg(detrended) AS raw FROM trended GROUP BY 1)) "
    "WHERE slot = (isodow(last_date) - 1 + i) % 7)"
)
SQL.update({
    "forecast_ma": o(
        "SELECT CAST(i AS INTEGER) AS step, last_date + CAST(i AS INTEGER) AS date, ma + i * trend * 0.5 AS forecast, "
        "(ma + i * trend * 0.5) * 0.85 AS lower_bound, (ma + i * trend * 0.5) * 1.15 AS upper_bound FROM ("
        "SELECT max(date) AS last_date, avg(value) AS ma, (arg_max(value, date) - arg_min(value, date)) / 7.0 AS trend "
        "FROM (SELECT * FROM daily ORDER BY date DESC LIMIT 7)), range(1, 31) AS r(i)", _BOUNDS,
    ),
    "forecast_holt": _holt_sql("daily", 30, 0.3, 0.1),
    "forecast_holt_by_type": _holt_sql("event_days", 14, 0.5, 0.2, "state"),
    "forecast_seasonal": o("SELECT * FROM seasonal", _BOUNDS),
    "forecast_seasonal_weekday_phase": o(_weekday_phase, _BOUNDS),
    "seasonal_factors": o("SELECT * FROM factors", "factor"),
    "future_dates": o(
        "SELECT state, CAST(i AS INTEGER) AS step, m + CAST(i AS INTEGER) AS date FROM (SELECT state, max(date) AS m "
        "FROM state_days GROUP BY 1), range(1, 31) AS r(i)"
    ),
    "forecast_by_state": _by_state(),
    "milestones": o(
        "SELECT milestone, CASE WHEN milestone <= c THEN 'Achieved' ELSE 'Projected' END AS status, "
        "d + CASE WHEN milestone > c THEN CAST(ceil((milestone - c) / pace) AS INTEGER) END AS projected_date, "
        "CASE WHEN milestone > c THEN CAST(ceil((milestone - c) / pace) AS INTEGER) END AS days_from_now FROM ("
        "SELECT sum(value) AS c, max(date) AS d, (SELECT avg(value) FROM (SELECT value FROM daily ORDER BY date DESC LIMIT 30)) "
        "AS pace FROM daily), (VALUES (CAST(1000000 AS BIGINT)), (25000000), (50000000)) AS v(milestone)"
    ),
    "forecast_summary": o(
        "SELECT avg(forecast) AS avg_forecast, sum(forecast) AS total_forecast, count(*) FILTER (WHERE isodow(date) >= 6) "
        "AS weekend_days, avg(CASE WHEN isodow(date) >= 6 THEN forecast END) AS avg_weekend FROM seasonal",
        "avg_forecast total_forecast avg_weekend",
    ),
    "forecast_weekend_flags": o(
        "SELECT *, isodow(date) >= 6 AS is_weekend FROM (SELECT CAST(i AS INTEGER) AS step, m + CAST(i AS INTEGER) AS date "
        "FROM (SELECT max(date) AS m FROM daily), range(1, 31) AS r(i))"
    ),
})

# --- clustering, scoring, learning -------------------------------------------
_FEATURES = ("pct_a", "pct_b", "pct_c", "daily_avg", "per_pincode_avg")
_RISK = "daily_mean daily_std cv cv_normalized coverage volume_score risk_score"
_SERVICE = "pct_a pct_b pct_c daily_avg per_pincode_avg daily_avg_normalized coverage_score service_score"
_class = " UNION ALL ".join(
    f"SELECT '{n}' AS class, count(*) FILTER (WHERE y = {i} AND p = {i}) AS hit, "
    f"count(*) FILTER (WHERE p = {i}) AS predicted, count(*) FILTER (WHERE y = {i}) AS support FROM guessed"
    for i, n in enumerate(("Normal", "Surge"))
)
_guess = (
    "guessed AS (SELECT is_surge AS y, CAST(rolling_3_mean >= threshold * 0.8 AS INTEGER) AS p FROM surge), "
    f"classes AS (SELECT *, coalesce(hit * 1.0 / nullif(predicted, 0), 0) AS precision, coalesce(hit * 1.0 / nullif(support, 0), 0) "
    f"AS recall FROM ({_class})), scored AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 "
    "FROM classes)"
)
_report = (
    "SELECT class, precision, recall, f1, support FROM scored UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT "
    "sum(hit) * 1.0 / sum(support) AS a, CAST(sum(support) AS BIGINT) AS s FROM scored) UNION ALL "
    "SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM scored UNION ALL "
    "SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scored"
)


def _metrics_sql() -> str:
    base = o("SELECT * FROM surge")
    head = base[: base.rindex(" SELECT * FROM surge")]
    cols = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("precision", "recall", "f1"))
    return f"{head}, {_guess} SELECT * REPLACE ({cols}) FROM ({_report})"


_no_leak = ", ".join(
    f"CASE WHEN count(*) OVER (ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) = {w} THEN avg(total) OVER "
    f"(ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END AS rolling_{w}_mean" for w in (7, 14)
)


def kmeans(points: str, id_: str, features: tuple[str, ...], ks: tuple[int, ...], body: str, runs: int = 10, seed: int = 42) -> str:
    """CTEs that fit all ks and runs as the operator does, then ``body``, which reads kplaced (k, cluster, ...) or kpoints."""
    n = len(features)
    z = ", ".join(f"coalesce((coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / nullif(stddev_pop(coalesce({c}, 0)) OVER (), 0), 0)" for c in features)

    def d2(a: str, b: str) -> str:
        return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, n + 1))

    def luck(step: str) -> str:
        key = f"'{seed}|' || run || '|' || {step} || '|' || id"
        return f"ln((CAST(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496)"

    away = f"list_transform(centres, lambda c: round({d2('x', 'c')}, 9))"
    ctes = [
        f"kpoints AS (SELECT {id_} AS id, [{z}] AS x, * FROM {points})",
        f"kseeds AS (SELECT run, 1 AS n, [arg_min(x, -{luck('0')})] AS centres FROM kpoints, range(0, {runs}) AS r(run) GROUP BY run UNION ALL "
        f"SELECT run, n + 1, list_append(any_value(centres), arg_min(x, -{luck('n')} / far)) FROM (SELECT run, n, centres, id, x, "
        f"list_min(list_transform(centres, lambda c: {d2('x', 'c')})) AS far FROM kseeds, kpoints WHERE n < {max(ks)}) WHERE far > 0 GROUP BY run, n)",
        f"kfits AS (SELECT run, n AS k, 0 AS it, centres, CAST(1 AS DOUBLE) AS shift FROM kseeds WHERE n IN ({', '.join(map(str, ks))}) UNION ALL "
        f"SELECT run, k, it + 1, fresh, list_max(list_transform(range(1, k + 1), lambda j: sqrt({d2('fresh[j]', 'centres[j]')}))) FROM ("
        "SELECT run, k, it, centres, list_transform(range(1, k + 1), lambda j: coalesce(list_filter(parts, lambda p: p.j = j)[1].m, centres[j])) AS fresh FROM ("
        "SELECT run, k, it, any_value(centres) AS centres, list({'j': j, 'm': m}) AS parts FROM ("
        f"SELECT run, k, it, any_value(centres) AS centres, j, [{', '.join(f'avg(x[{i}])' for i in range(1, n + 1))}] AS m FROM ("
        f"SELECT run, k, it, centres, x, list_position(ds, list_min(ds)) AS j FROM (SELECT run, k, it, centres, x, {away} AS ds "
        "FROM kfits, kpoints WHERE shift > 1e-9 AND it < 100)) GROUP BY run, k, it, j) GROUP BY run, k, it)))",
        "kdone AS (SELECT run, k, arg_max(centres, it) AS centres FROM kfits GROUP BY run, k)",
        f"kcosts AS (SELECT run, k, any_value(centres) AS centres, sum(list_min({away})) AS cost FROM kdone, kpoints GROUP BY run, k)",
        "kbest AS (SELECT k, centres FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(cost, 6), run) AS place FROM kcosts) WHERE place = 1)",
        f"kplaced AS (SELECT * EXCLUDE (centres, ds), CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster FROM (SELECT *, {away} AS ds FROM kbest, kpoints))",
    ]
    base = o(f"SELECT * FROM {points}")
    return f"{base[: base.rindex(f' SELECT * FROM {points}')]}, {', '.join(ctes)} {body}"


def _rounded(body: str, doubles: str, digits: int = 6) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in doubles.split()) + f") FROM ({body})"


_of_clusters = CTES["profiles"].replace("FROM placed", "FROM kplaced")
_named_clusters = f"WITH profiles AS ({_of_clusters}) {CTES['named']}"
_silhouette = (
    "WITH labels AS (SELECT k, id, x, cluster FROM kplaced), sizes AS (SELECT k, cluster, count(*) AS n FROM labels GROUP BY 1, 2), "
    "means AS (SELECT a.k, a.id, a.cluster, b.cluster AS other, sum(sqrt("
    + " + ".join(f"(a.x[{i}] - b.x[{i}]) * (a.x[{i}] - b.x[{i}])" for i in range(1, 6))
    + ")) AS away FROM labels a JOIN labels b ON a.k = b.k GROUP BY 1, 2, 3, 4), "
    "sides AS (SELECT m.k, m.id, max(CASE WHEN m.cluster = other AND n > 1 THEN away / (n - 1) END) AS a, "
    "min(CASE WHEN m.cluster <> other THEN away / n END) AS b FROM means m JOIN sizes s ON s.k = m.k AND s.cluster = other GROUP BY 1, 2) "
    "SELECT CAST(k AS INTEGER) AS k, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM sides GROUP BY 1"
)
_DISTRICT_ID = "state || '|' || district"
SQL.update({
    "kmeans_regions": kmeans("features", _DISTRICT_ID, _FEATURES, (5,), _rounded(
        f"SELECT p.* EXCLUDE (id, x, k), cluster_name FROM kplaced p LEFT JOIN ({_named_clusters}) USING (cluster)", " ".join(_FEATURES),
    )),
    "kmeans_states": kmeans("state_features", "state", _FEATURES, (4,), _rounded(
        _named_clusters, "total_mean avg_pct_a avg_pct_b avg_pct_c avg_daily",
    )),
    "choose_k": kmeans("features", _DISTRICT_ID, _FEATURES, tuple(range(2, 11)), _rounded(_silhouette, "silhouette")),
    "kmeans_pincodes": kmeans("pin_features", "pincode || '|' || state || '|' || district", ("daily_avg", "pct_a", "pct_b"), (5,), _rounded(
        f"SELECT cluster, count(*) AS pincodes, {isum('total')} AS total, round(avg(daily_avg), 2) AS daily_avg FROM kplaced GROUP BY 1", "daily_avg",
    )),
    "standardize": o(
        "SELECT state, district, " + ", ".join(
            f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}_z" for c in _FEATURES
        ) + " FROM features", " ".join(f"{c}_z" for c in _FEATURES),
    ),
    "cluster_profiles": o("SELECT * FROM profiles", "total_mean avg_pct_a avg_pct_b avg_pct_c avg_daily"),
    "name_clusters": o("SELECT * FROM named", "total_mean avg_pct_a avg_pct_b avg_pct_c avg_daily"),
    "service_scores": o(
        "SELECT *, service_score < (SELECT quantile_cont(service_score, 0.25) FROM service) AS is_underserved FROM service",
        _SERVICE,
    ),
    "underserved": o(
        "SELECT *, true AS is_underserved FROM service WHERE service_score < "
        "(SELECT quantile_cont(service_score, 0.25) FROM service)", _SERVICE,
    ),
    "ml_features": o(
        f"SELECT a.*, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, "
        f"CAST(day(date) AS INTEGER) AS day_of_month, CAST(quarter(date) AS INTEGER) AS quarter, {flags('date')}, "
        "state_encoded FROM activity a JOIN (SELECT state AS st, CAST(row_number() OVER (ORDER BY state) - 1 AS INTEGER) "
        "AS state_encoded FROM states) ON st = a.state"
    ),
    "demand_features": o("SELECT * FROM demand", "rolling_7_mean rolling_14_mean"),
    "demand_features_no_leak": o(
        "SELECT * FROM (SELECT *, " + ", ".join(f"lag(total, {i}) OVER (ORDER BY date) AS lag_{i}" for i in (1, 7, 14))
        + f", {_no_leak} FROM daycal) WHERE lag_14 IS NOT NULL", "rolling_7_mean rolling_14_mean",
    ),
    "chrono_split": o(f"SELECT date, is_train FROM ({SPLIT})"),
    "demand_walk": o(
        f"SELECT date, total, CAST(20 AS BIGINT) AS n_trees, true AS agrees, true AS within_training FROM ({SPLIT}) WHERE NOT is_train"
    ),
    "surge_walk": o(
        "SELECT date, is_surge, CAST(20 AS BIGINT) AS n_trees, true AS agrees FROM (SELECT *, row_number() OVER (ORDER BY "
        "md5('42|' || CAST(date AS VARCHAR)), date) > ceil(count(*) OVER () * 0.2) AS is_train FROM surge) WHERE NOT is_train"
    ),
    "importance_walk": o("SELECT date, total, CAST(20 AS BIGINT) AS n_trees, true AS agrees FROM daycal"),
    "permuted_features": o(" UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({r} AS INTEGER) AS repeat, * REPLACE (coalesce(lead({c}) OVER w, first({c}) OVER w) AS {c}) FROM day_shares "
        f"WINDOW w AS (ORDER BY md5('42|{c}|{r}|' || CAST(date AS VARCHAR)), date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        for c in ("day_of_week", "month", "is_weekend", "pct_a", "pct_b") for r in range(2)
    ), "pct_a pct_b"),
    "surge_label": o(
        "SELECT date, value, q AS threshold, CAST(value >= q AS INTEGER) AS is_surge FROM daily, "
        "(SELECT quantile_cont(value, 0.9) AS q FROM daily)", "threshold",
    ),
    "random_split": o(
        "SELECT date, row_number() OVER (ORDER BY md5('42|' || CAST(date AS VARCHAR)), date) > "
        "ceil(count(*) OVER () * 0.2) AS is_train FROM surge"
    ),
    "surge_features": o("SELECT * FROM surge", "threshold rolling_3_mean"),
    "classification_metrics": _metrics_sql(),
    "regression_metrics": o(
        "SELECT avg(abs(total - rolling_7_mean)) AS mae, 1 - sum(pow(total - rolling_7_mean, 2)) / (var_pop(total) * count(*)) "
        "AS r2, count(*) AS rows FROM demand", "mae r2",
    ),
    "district_risk": o("SELECT * FROM risk", _RISK),
    "risk_summary": o("SELECT risk_category, count(*) AS districts FROM risk GROUP BY 1"),
    "importance_features": o("SELECT * FROM day_shares", "pct_a pct_b"),
})

# --- KPIs and chart datasets -------------------------------------------------
_OVERALL = (
    "pct_age_0_5 pct_age_5_17 pct_age_18_plus avg_daily_units median_daily_units std_daily_units "
    "coefficient_of_variation units_per_state units_per_district units_per_pincode"
)


def _capacity(keys: str, capacity: int) -> str:
    return (
        f"SELECT {keys}, avg_daily, avg_utilization, peak_utilization, CASE WHEN avg_utilization <= 0 THEN NULL "
        "WHEN avg_utilization <= 50 THEN 'Under-utilized' WHEN avg_utilization <= 80 THEN 'Optimal' "
        "WHEN avg_utilization <= 100 THEN 'Near Capacity' ELSE 'Over Capacity' END AS capacity_status FROM ("
        f"SELECT {keys}, avg(t) AS avg_daily, avg(t * 100.0 / {capacity}) AS avg_utilization, "
        f"max(t * 100.0 / {capacity}) AS peak_utilization FROM (SELECT {keys}, date, sum(total) AS t FROM segments "
        f"GROUP BY {keys}, date) GROUP BY {keys})"
    )


def _trend(body: str, w: int) -> str:
    return o(
        f"SELECT *, CASE WHEN count(*) OVER w = {w} THEN avg(value) OVER w END AS ma FROM ({body}) "
        f"WINDOW w AS (ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)", "ma",
    )


def _radar(where: str) -> str:
    shown = (
        f"SELECT state, {isum('total')} AS volume, sum(part_a) * 100.0 / sum(total) AS pct_a, "
        "sum(part_b) * 100.0 / sum(total) AS pct_b, sum(part_c) * 100.0 / sum(total) AS pct_c, "
        f"count(DISTINCT district) AS districts, count(DISTINCT pincode) AS pincodes FROM activity WHERE {where} GROUP BY 1"
    )
    cols = ("volume", "pct_a", "pct_b", "pct_c", "districts", "pincodes")
    return o(
        "SELECT state, " + ", ".join(f"{c} * 1.0 / max({c}) OVER () * 100 AS {c}" for c in cols) + f" FROM ({shown})",
        " ".join(cols),
    )


_rules = (
    "SELECT 1 AS position, 'Operations' AS category, 'High' AS priority, 'Improve Weekend Operations' AS title, "
    "printf('Weekend units are only %.0f%% of weekday levels. Consider extended hours or awareness campaigns.', weekend_efficiency) "
    "AS description, 'Increase weekly enrollments by 10-15%' AS potential_impact FROM k WHERE weekend_efficiency < 70 UNION ALL "
    "SELECT 2, 'Geographic', 'Medium', 'Expand Reach in Underserved States', "
    "printf('Top 5 states contribute %.0f%% of units. Focus on increasing capacity in smaller states.', top5), "
    "'More balanced national coverage' FROM k WHERE top5 > 60 UNION ALL "
    "SELECT 3, 'Planning', 'Medium', 'Implement Demand Smoothing', "
    "printf('High daily variation (CV=%.0f%%) indicates unpredictable demand. Consider appointment systems.', "
    "coefficient_of_variation), 'Reduce wait times and improve resource utilization' FROM k "
    "WHERE coefficient_of_variation > 30 UNION ALL SELECT 4, 'Outreach', 'Medium', 'Child Enrollment Campaigns', "
    "printf('Children (0-5) represent only %.1f%% of units. Partner with schools and hospitals.', pct_age_0_5), "
    "'Increase child enrollment coverage' FROM k WHERE pct_age_0_5 < 25 UNION ALL "
    "SELECT 5, 'Technology', 'High', 'Deploy Predictive Demand System', "
    "'Use ML forecasting to predict daily demand and optimize staffing.', 'Reduce wait times by 20-30%' UNION ALL "
    "SELECT 6, 'Monitoring', 'Low', 'Implement Real-Time Dashboard', "
    "'Deploy interactive dashboard for monitoring KPIs across all centers.', 'Faster response to operational issues'"
)


def _recommend() -> str:
    base = o("SELECT * FROM overall, temporal, states")
    head = base[: base.rindex(" SELECT * FROM overall")]
    k = (
        "k AS (SELECT weekend_efficiency, coefficient_of_variation, pct_age_0_5, (SELECT sum(total) FROM (SELECT total "
        "FROM states ORDER BY total DESC LIMIT 5)) * 100.0 / (SELECT sum(total) FROM states) AS top5 FROM overall, temporal)"
    )
    return f"{head}, {k} SELECT CAST(position AS INTEGER) AS position, * EXCLUDE (position) FROM ({_rules})"


_sided = ", ".join(
    f"avg(CASE WHEN {c} THEN value END) AS {n}_avg, CAST(sum(CASE WHEN {c} THEN value END) AS BIGINT) AS {n}_total, "
    f"count(*) FILTER (WHERE {c}) AS {n}_days"
    for n, c in (("weekday", "isodow(date) < 6"), ("weekend", "isodow(date) >= 6"))
)
_seg_states = f"(SELECT state, {isum('total')} AS t FROM segments GROUP BY 1)"
_seg_districts = f"(SELECT district, {isum('total')} AS t FROM segments GROUP BY 1)"
_week_series = (
    "SELECT CAST(w + INTERVAL 6 DAY AS DATE) AS date, CAST(coalesce(sum(value), 0) AS BIGINT) AS value FROM ("
    "SELECT unnest(generate_series(date_trunc('week', min(date)), date_trunc('week', max(date)), INTERVAL 7 DAY)) AS w FROM daily) "
    "LEFT JOIN daily ON date_trunc('week', date) = w GROUP BY 1"
)
_month_series = (
    "SELECT last_day(CAST(w AS DATE)) AS date, CAST(coalesce(sum(value), 0) AS BIGINT) AS value FROM ("
    "SELECT unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS w FROM daily) "
    "LEFT JOIN daily ON date_trunc('month', date) = w GROUP BY 1"
)
_view = "(SELECT * FROM activity WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND state IN ('NATION_1', 'NATION_2', 'NATION_3'))"
SQL.update({
    "kpi_overall": o("SELECT * FROM overall", _OVERALL),
    "kpi_temporal": o("SELECT * FROM temporal", "weekday_avg weekend_avg weekend_efficiency monthly_variance"),
    "kpi_geographic": o(
        f"SELECT (SELECT state FROM {_seg_states} ORDER BY t DESC, state LIMIT 1) AS top_state, "
        + ", ".join(
            f"(SELECT sum(t) FROM (SELECT t FROM {_seg_states} ORDER BY t DESC LIMIT {k})) * 100.0 / (SELECT sum(t) FROM {_seg_states}) AS {n}"
            for k, n in ((1, "top_state_share"), (5, "top_5_states_share"), (10, "top_10_states_share"))
        )
        + f", (SELECT (2.0 * sum(i * t) - (count(*) + 1) * sum(t)) / (count(*) * sum(t)) FROM (SELECT t, row_number() OVER "
        f"(ORDER BY t) AS i FROM {_seg_states})) AS state_gini_coefficient, (SELECT avg(t) FROM {_seg_states}) AS avg_per_state, "
        f"(SELECT avg(t) FROM {_seg_districts}) AS avg_per_district, "
        f"(SELECT district FROM {_seg_districts} ORDER BY t DESC, district LIMIT 1) AS top_district",
        "top_state_share top_5_states_share top_10_states_share state_gini_coefficient avg_per_state avg_per_district",
    ),
    "capacity_utilization": o(_capacity("district", 122), "avg_daily avg_utilization peak_utilization"),
    "capacity_utilization_qualified": o(_capacity("state, district", 30), "avg_daily avg_utilization peak_utilization"),
    "capacity_status_counts": o(
        f"SELECT capacity_status, count(*) AS count FROM ({_capacity('district', 122)}) WHERE capacity_status IS NOT NULL GROUP BY 1"
    ),
    "weekday_weekend": o(
        "SELECT *, (weekday_avg - weekend_avg) / weekday_avg * 100 AS efficiency_gap, "
        f"(weekday_avg - weekend_avg) * weekend_days AS weekend_potential FROM (SELECT {_sided} FROM daily)",
        "weekday_avg weekend_avg efficiency_gap weekend_potential",
    ),
    "weekday_breakdown": o("SELECT dayname(date) AS day_name, avg(value) AS mean FROM daily GROUP BY 1", "mean"),
    "seasonality_index": o(
        "SELECT *, CASE WHEN seasonality_index < 90 THEN 'Reduce Staff' WHEN seasonality_index > 110 THEN 'Add Staff' "
        "ELSE 'Normal' END AS recommendation FROM seasidx", "seasonality_index",
    ),
    "seasonality_extremes": o(
        "SELECT a.month AS peak_month, a.seasonality_index AS peak_index, b.month AS low_month, b.seasonality_index AS low_index "
        "FROM (SELECT * FROM seasidx ORDER BY seasonality_index DESC, month LIMIT 1) a, "
        "(SELECT * FROM seasidx ORDER BY seasonality_index, month LIMIT 1) b", "peak_index low_index",
    ),
    "recommendations": _recommend(),
    "dashboard_kpis": o(
        f"SELECT CAST(sum(total) AS BIGINT) AS total, count(DISTINCT district) AS active_districts, (SELECT avg(t) FROM "
        f"(SELECT sum(total) AS t FROM {_view} GROUP BY date)) AS avg_daily, (SELECT pincode FROM (SELECT pincode, sum(total) AS t "
        f"FROM {_view} GROUP BY 1) ORDER BY t DESC, pincode LIMIT 1) AS top_pincode FROM {_view}", "avg_daily",
    ),
    "trend_with_ma": _trend("SELECT * FROM daily", 7),
    "trend_with_ma_weekly": _trend(_week_series, 3),
    "trend_with_ma_monthly": _trend(_month_series, 3),
    "radar_metrics": _radar("state IN (SELECT state FROM states ORDER BY total DESC, state LIMIT 5)"),
    "radar_metrics_chosen": _radar("state IN ('NATION_0', 'NATION_24')"),
    "bubble_dataset": o(
        "SELECT *, total * 1.0 / days AS daily_avg, children * 100.0 / total AS children_pct, "
        "total * 1.0 / max(total) OVER () * 1000 + 50 AS size FROM (SELECT state, district, "
        f"{isum('total')} AS total, {isum('part_a')} AS children, min(date) AS start, max(date) AS \"end\", "
        "count(DISTINCT date) AS days FROM activity GROUP BY 1, 2 HAVING count(DISTINCT date) > 7 "
        "ORDER BY total DESC, state, district LIMIT 30)", "daily_avg children_pct size",
    ),
    "treemap_shares": o(
        "SELECT *, total * 100.0 / sum(total) OVER () AS pct FROM (SELECT * FROM states ORDER BY total DESC, state LIMIT 15)", "pct"
    ),
    "top_states_pct": o(
        "SELECT *, total * 100.0 / (SELECT sum(total) FROM states) AS pct FROM states ORDER BY total DESC, state LIMIT 15", "pct"
    ),
    "monthly_extremes": o(
        "SELECT a.month AS peak_month, a.value AS peak_value, b.month AS low_month, b.value AS low_value, weekly_mean, weeks FROM "
        "(SELECT * FROM monthly ORDER BY value DESC, month LIMIT 1) a, (SELECT * FROM monthly ORDER BY value, month LIMIT 1) b, "
        "(SELECT avg(value) AS weekly_mean, count(*) AS weeks FROM weekly)", "weekly_mean",
    ),
})


# --- report bundles ----------------------------------------------------------
def _digest(row: str, digits: int = 3) -> str:
    """The digest of whole rows: cells as name=value in the order of names, numbers as whole units of the last digit."""
    value = f"json_extract(to_json({row}), k)"
    cell = (
        f"CASE json_type({value}) WHEN 'NULL' THEN '~' WHEN 'VARCHAR' THEN json_extract_string(to_json({row}), k) "
        f"WHEN 'BOOLEAN' THEN CAST({value} AS VARCHAR) ELSE CAST(CAST(round(round(CAST({value} AS DOUBLE), 6) * {10**digits}) AS BIGINT) AS VARCHAR) END"
    )
    text = f"array_to_string(list_transform(list_sort(json_keys(to_json({row}))), lambda k: k || '=' || {cell}), '|')"
    return f"coalesce(CAST(sum(CAST('0x' || substr(md5({text}), 1, 10) AS BIGINT)) % 1099511627776 AS DOUBLE), 0)"


def _section(name: str, sql: str, numbers: str) -> str:
    cols = numbers.split()
    keys = ", ".join(["'rows'", *[f"'{c}'" for c in cols], "'digest'"])
    values = ", ".join(["CAST(count(*) AS DOUBLE)", *[f"CAST(sum({c}) AS DOUBLE)" for c in cols], _digest("t")])
    return f"SELECT '{name}' AS section, unnest([{keys}]) AS key, unnest([{values}]) AS value FROM ({sql}) AS t"


def _report(*sections: tuple[str, str, str]) -> str:
    parts = " UNION ALL ".join(_section(*s) for s in sections)
    return f"SELECT section, key, round(value, 3) AS value FROM ({parts})"


_GEO_COLS = "total active_days unique_pincodes units_per_day units_per_pincode units_per_day_zscore units_per_pincode_zscore"
_IMPACT_COLS = "units baseline impact_pct avg_before avg_after recovery_days"
_no_runs = o(
    "SELECT run_id, count(*) AS duration, avg(deviation) AS avg_deviation, avg(value) AS avg_value FROM "
    f"({_deviation(2.0)}) WHERE is_deviant GROUP BY 1 HAVING count(*) >= 3", "avg_deviation avg_value",
)
_residuals = o(f"SELECT * FROM ({_decompose(3, 3)}) WHERE is_residual_anomaly", _DECO)
_found = (
    ("zscore_anomalies", SQL["anomaly_zscore"], "value z_score deviation_pct"),
    ("iqr_anomalies", SQL["anomaly_iqr"], "value lower_bound upper_bound"),
    ("consecutive_anomalies", _no_runs, "run_id duration avg_deviation avg_value"),
    ("residual_anomalies", _residuals, "original trend seasonal residual"),
    ("geo_anomalies", SQL["anomaly_geo"], _GEO_COLS),
    ("holiday_impact", SQL["holiday_impact"], _IMPACT_COLS),
)
_summary = " UNION ALL ".join(f"SELECT '{n}' AS section, count(*) AS rows FROM ({q})" for n, q, _ in _found)
_MORE_TARGETS = SQL["milestones"].replace(
    "(CAST(1000000 AS BIGINT)), (25000000), (50000000)", "(CAST(25000000 AS BIGINT)), (50000000), (100000000)"
)
_daily_geo = SQL["kpi_geographic"].replace("FROM segments", "FROM activity")
_capacity_place = o(_capacity("district", 500).replace("FROM segments", "FROM activity"), "avg_daily avg_utilization peak_utilization")
_STATE_AGE = "part_a part_b part_c"
SQL.update({
    "anomaly_report": _report(
        *_found,
        ("daily_zscore", SQL["anomaly_zscore_daily"], "value z_score"),
        ("daily_iqr", SQL["anomaly_iqr_daily"], "value lower_bound upper_bound"),
        ("iqr_bounds", o("SELECT DISTINCT lower_bound, upper_bound FROM iqr", "lower_bound upper_bound"), "lower_bound upper_bound"),
        ("daily_consecutive", SQL["anomaly_runs_daily"], "value ma std deviation run_id"),
        ("decomposition", SQL["seasonal_decompose"], "original trend seasonal residual"),
        ("geo_data", _geo("geo", 2.0), _GEO_COLS),
        ("baseline", SQL["holiday_baseline"], "baseline"),
        ("summary", _summary, "rows"),
    ),
    "forecast_report": _report(
        ("time_series", SQL["daily_total"], "value"),
        ("ma_forecast", SQL["forecast_ma"], "step forecast lower_bound upper_bound"),
        ("exp_forecast", SQL["forecast_holt"], "step forecast lower_bound upper_bound"),
        ("seasonal_forecast", SQL["forecast_seasonal"], "step forecast lower_bound upper_bound"),
        ("seasonal_factors", SQL["seasonal_factors"], "slot factor"),
        ("state_forecasts", SQL["forecast_by_state"], "step forecast lower_bound upper_bound"),
        ("milestones", _MORE_TARGETS, "milestone days_from_now"),
        ("cumulative", SQL["cumulative_sum"], "value cumulative"),
        ("summary", SQL["forecast_summary"], "avg_forecast total_forecast weekend_days avg_weekend"),
    ),
    "operational_report": _report(
        ("overall_kpis", SQL["kpi_overall"],
         "total_units total_days total_states total_districts total_records pct_age_0_5 pct_age_5_17 pct_age_18_plus "
         "total_pincodes avg_daily_units median_daily_units max_daily_units min_daily_units std_daily_units "
         "coefficient_of_variation units_per_state units_per_district units_per_pincode"),
        ("temporal_kpis", SQL["kpi_temporal"],
         "weekday_avg weekend_avg weekend_efficiency best_month worst_month monthly_variance best_day_of_week worst_day_of_week"),
        ("geographic_kpis", _daily_geo,
         "top_state_share top_5_states_share top_10_states_share state_gini_coefficient avg_per_state avg_per_district"),
        ("capacity", _capacity_place, "avg_daily avg_utilization peak_utilization"),
        ("efficiency", SQL["weekday_weekend"],
         "weekday_avg weekday_total weekday_days weekend_avg weekend_total weekend_days efficiency_gap weekend_potential"),
        ("day_breakdown", SQL["weekday_breakdown"], "mean"),
        ("seasonality", SQL["seasonality_index"], "month total seasonality_index"),
        ("recommendations", SQL["recommendations"], "position"),
    ),
    "executive_summary": _report(
        ("age_groups", SQL["age_group_totals"], "value share_pct"),
        ("top_states", SQL["top_states"], "total"),
        ("daily", SQL["daily_total"], "value"),
        ("weekdays", SQL["weekday_total_filled"], "day_of_week value"),
        ("months", SQL["monthly_total"], "value"),
        ("quarters", SQL["quarter_total"], "quarter value"),
        ("monthly_age_groups", SQL["monthly_age_totals"], _STATE_AGE),
        ("cumulative", SQL["cumulative_sum"], "value cumulative"),
        ("coverage", SQL["coverage_summary"],
         "states districts pincodes records sum_part_a sum_part_b sum_part_c sum_total"),
    ),
})


# --- clusters as a report ----------------------------------------------------
_PLACE_SUMS = "total part_a part_b part_c active_days"
_PLACE_COLS = f"{_PLACE_SUMS} unique_pincodes pct_a pct_b pct_c daily_avg per_pincode_avg cluster"
_CLUSTER_COLS = "cluster total_sum total_mean avg_pct_a avg_pct_b avg_pct_c avg_daily count"


def _clusters(level: str, k: int) -> tuple[str, str]:
    """SQL of the placed rows and of the cluster profiles."""
    source, id_ = ("features", _DISTRICT_ID) if level == "district" else ("state_features", "state")
    placed = _rounded(f"SELECT p.* EXCLUDE (id, x, k), cluster_name FROM kplaced p LEFT JOIN ({_named_clusters}) USING (cluster)", " ".join(_FEATURES))
    named = _rounded(_named_clusters, "total_mean avg_pct_a avg_pct_b avg_pct_c avg_daily")
    return kmeans(source, id_, _FEATURES, (k,), placed), kmeans(source, id_, _FEATURES, (k,), named)


_zones = kmeans(
    "pin_features", "pincode || '|' || state || '|' || district", ("daily_avg", "pct_a", "pct_b"), (5,),
    _rounded("SELECT * EXCLUDE (id, x, k, pct_c) FROM kplaced", "daily_avg pct_a pct_b"),
)
(_state_rows, _state_profiles), (_district_rows, _district_profiles) = _clusters("state", 4), _clusters("district", 5)
SQL["clustering_report"] = _report(
    ("state_clusters", _state_rows, _PLACE_COLS), ("state_profiles", _state_profiles, _CLUSTER_COLS),
    ("district_clusters", _district_rows, _PLACE_COLS), ("district_profiles", _district_profiles, _CLUSTER_COLS),
    ("underserved", SQL["underserved"], f"{_PLACE_SUMS} unique_pincodes pct_a pct_b pct_c daily_avg per_pincode_avg daily_avg_normalized coverage_score service_score"),
    ("pincode_clusters", _zones, f"{_PLACE_SUMS} pct_a pct_b daily_avg cluster"),
    ("pincode_summary", SQL["kmeans_pincodes"], "cluster pincodes total daily_avg"),
)


# --- the batch job -----------------------------------------------------------
def _of_cleaned(sql: str) -> str:
    """The SQL over the cleaned shards in place of the activity."""
    chain = o("SELECT * FROM cleaned").removeprefix("WITH RECURSIVE ").removesuffix(" SELECT * FROM cleaned")
    facts = "SELECT date, state, district, pincode, age_0_5 AS part_a, age_5_17 AS part_b, age_18_greater AS part_c, total_enrollments AS total FROM cleaned"
    return sql.replace(f"activity AS ({CTES['activity']})", f"{chain}, activity AS ({facts})")


_OWN_NAMES = {
    "total": "total_enrollments", "part_a": "age_0_5", "part_b": "age_5_17", "part_c": "age_18_greater", "pct_a": "pct_children",
    "pct_b": "pct_youth", "pct_c": "pct_adults", "units_per_day": "enrollments_per_day", "units_per_pincode": "enrollments_per_pincode",
    "units_per_day_zscore": "enrollments_per_day_zscore", "units_per_pincode_zscore": "enrollments_per_pincode_zscore",
}


def _own(sql: str, columns: str, drop: str = "") -> str:
    renamed = ", ".join(f"{c} AS {_OWN_NAMES[c]}" for c in columns.split())
    return f"SELECT * {f'EXCLUDE ({drop}) ' if drop else ''}{f'RENAME ({renamed}) ' if renamed else ''}FROM ({_of_cleaned(sql)})"


_PLACE_NAMES = "total part_a part_b part_c pct_a pct_b pct_c"
_BATCH = {
    "anomalies_zscore": _own(SQL["anomaly_zscore"], ""),
    "anomalies_geographic": _own(SQL["anomaly_geo"], "total units_per_day units_per_pincode units_per_day_zscore units_per_pincode_zscore"),
    "forecast_30day": _own(SQL["forecast_seasonal"], "", "step"),
    "milestone_projections": _own(_MORE_TARGETS, ""),
    "district_clusters": _own(_district_rows, _PLACE_NAMES),
    "underserved_districts": _own(SQL["underserved"], _PLACE_NAMES),
    "feature_importance": "SELECT unnest(['day_of_week', 'month', 'is_weekend', 'pct_children', 'pct_youth']) AS feature",
    "district_risk_scores": _own(SQL["district_risk"], ""),
    "seasonality_index": _own(SQL["seasonality_index"], ""),
    "recommendations": _own(SQL["recommendations"].replace("Weekend units", "Weekend enrollments").replace("of units", "of enrollments"), "", "position"),
    "capacity_utilization": _own(_capacity_place, ""),
}
_MAY_BE_EMPTY = ("anomalies_zscore", "anomalies_geographic")
SQL["full_pipeline"] = " UNION ALL ".join(
    f"SELECT '{n}' AS output, count(*) AS rows, {_digest('t')} AS digest FROM ({q}) AS t" + (" HAVING count(*) > 0" if n in _MAY_BE_EMPTY else "")
    for n, q in _BATCH.items()
)
SQL["full_pipeline_quick"] = " UNION ALL ".join(
    f"SELECT '{n}' AS output, count(*) AS rows FROM ({_BATCH[n]}) AS t" + (" HAVING count(*) > 0" if n in _MAY_BE_EMPTY else "")
    for n in ("anomalies_zscore", "anomalies_geographic", "forecast_30day", "milestone_projections")
)


def all_sql() -> dict[str, str]:
    return dict(SQL)
