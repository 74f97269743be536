"""Building blocks of the checking SQL: shared CTEs and output rounding."""

from __future__ import annotations

import re

DATE = "CAST(l_shipdate AS DATE)"

NUMBER = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def strip(s: str) -> str:
    return rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"


def title(s: str) -> str:
    """Capitalise every run of letters, character by character."""
    ch = f"substr({s}, i, 1)"
    before = f"substr({s}, i - 1, 1)"
    return (
        f"array_to_string(list_transform(range(1, len({s}) + 1), lambda i: CASE WHEN i = 1 "
        f"OR NOT regexp_matches({before}, '[A-Za-z]') THEN upper({ch}) ELSE lower({ch}) END), '')"
    )


def null_token(s: str) -> str:
    return f"CASE WHEN {s} NOT IN ('Nan', 'None', 'nan', 'NONE', '') THEN {s} END"


def number(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, {NUMBER}) THEN TRY_CAST(trim({s}) AS DOUBLE) END"


def count(s: str) -> str:
    n = number(s)
    return f"coalesce(CAST(trunc(CASE WHEN ({n}) >= 0 THEN {n} END) AS BIGINT), 0)"


def isum(expr: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT)"


def ints(expr: str) -> str:
    return f"CAST({expr} AS INTEGER)"


def calendar(d: str) -> str:
    return (
        f"CAST(year({d}) AS INTEGER) AS year, CAST(month({d}) AS INTEGER) AS month, "
        f"CAST(day({d}) AS INTEGER) AS day, CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week, "
        f"dayname({d}) AS day_name, monthname({d}) AS month_name, "
        f"CAST(quarter({d}) AS INTEGER) AS quarter, CAST(weekofyear({d}) AS INTEGER) AS week_of_year"
    )


def flags(d: str) -> str:
    return (
        f"CAST(isodow({d}) >= 6 AS INTEGER) AS is_weekend, "
        f"CAST(day({d}) <= 5 AS INTEGER) AS is_month_start, "
        f"CAST(day({d}) >= 26 AS INTEGER) AS is_month_end"
    )


SHARES = ", ".join(
    f"coalesce({p} * 100.0 / nullif(total, 0), 0) AS {s}"
    for p, s in (("part_a", "pct_a"), ("part_b", "pct_b"), ("part_c", "pct_c"))
)

_FROM = (
    "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey"
)


def _part(flag: str) -> str:
    return isum(f"CASE WHEN l_returnflag = '{flag}' THEN l_quantity ELSE 0 END")



CTES = {
    "activity": (
        f"SELECT {DATE} AS date, n_name AS state, n_name || '/' || c_mktsegment AS district, "
        "CAST(100000 + c_custkey AS VARCHAR) AS pincode, "
        f"{_part('R')} AS part_a, {_part('A')} AS part_b, {_part('N')} AS part_c, "
        f"{isum('l_quantity')} AS total FROM {_FROM} GROUP BY 1, 2, 3, 4"
    ),
    "segments": (
        "SELECT date, state, split_part(district, '/', 2) AS district, pincode, total FROM activity"
    ),
    "daily": f"SELECT date, {isum('total')} AS value FROM activity GROUP BY 1",
    "monthly": (
        f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, {isum('total')} AS value "
        "FROM activity GROUP BY 1"
    ),
    "weekly": (
        f"SELECT CAST(date_trunc('week', date) AS DATE) AS week, {isum('total')} AS value "
        "FROM activity GROUP BY 1"
    ),
    "states": f"SELECT state, {isum('total')} AS total FROM activity GROUP BY 1",
    "districts": f"SELECT state, district, {isum('total')} AS total FROM activity GROUP BY 1, 2",
    "state_days": f"SELECT state, date, {isum('total')} AS value FROM activity GROUP BY 1, 2",
    "event_days": (
        "SELECT event_type AS state, CAST(ts AS DATE) AS date, "
        f"{isum('CAST(floor(value * 100) AS BIGINT)')} AS value FROM events GROUP BY 1, 2"
    ),
    "holidays": (
        "SELECT * FROM (SELECT make_date(y, 1, 1) AS date, 'New Year' AS holiday FROM years "
        "UNION ALL SELECT make_date(y, 12, 25), 'Christmas' FROM years)"
    ),
    "years": "SELECT CAST(unnest(range(1990, 2011)) AS BIGINT) AS y",
    "features": (
        f"SELECT *, {SHARES}, total * 1.0 / active_days AS daily_avg, "
        "total * 1.0 / nullif(unique_pincodes, 0) AS per_pincode_avg FROM ("
        f"SELECT state, district, {isum('total')} AS total, {isum('part_a')} AS part_a, "
        f"{isum('part_b')} AS part_b, {isum('part_c')} AS part_c, "
        "count(DISTINCT date) AS active_days, count(DISTINCT pincode) AS unique_pincodes "
        "FROM activity GROUP BY 1, 2)"
    ),
    "state_features": (
        f"SELECT *, {SHARES}, total * 1.0 / active_days AS daily_avg, "
        "total * 1.0 / nullif(unique_pincodes, 0) AS per_pincode_avg FROM ("
        f"SELECT state, {isum('total')} AS total, {isum('part_a')} AS part_a, "
        f"{isum('part_b')} AS part_b, {isum('part_c')} AS part_c, "
        "count(DISTINCT date) AS active_days, count(DISTINCT pincode) AS unique_pincodes "
        "FROM activity GROUP BY 1)"
    ),
    "pin_features": f"SELECT *, {SHARES}, total * 1.0 / active_days AS daily_avg FROM pins",
    "daycal": (
        f"SELECT date, {isum('total')} AS total, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, "
        "CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, "
        f"{flags('date')} FROM activity GROUP BY date"
    ),
    "day_shares": (
        f"SELECT date, total, day_of_week, month, is_weekend, pct_a, pct_b FROM (SELECT *, {SHARES} FROM (SELECT date, "
        + ", ".join(f"{isum(c)} AS {c}" for c in ("part_a", "part_b", "part_c", "total"))
        + ", CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, "
        "CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend FROM activity GROUP BY date))"
    ),
    "demand": (
        "SELECT * FROM (SELECT *, lag(total, 1) OVER o AS lag_1, lag(total, 7) OVER o AS lag_7, "
        "lag(total, 14) OVER o AS lag_14, "
        "CASE WHEN count(*) OVER w7 = 7 THEN avg(total) OVER w7 END AS rolling_7_mean, "
        "CASE WHEN count(*) OVER w14 = 14 THEN avg(total) OVER w14 END AS rolling_14_mean "
        "FROM daycal WINDOW o AS (ORDER BY date), "
        "w7 AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), "
        "w14 AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) WHERE lag_14 IS NOT NULL"
    ),
    "surge": (
        "SELECT * FROM (SELECT *, (SELECT quantile_cont(total, 0.9) FROM daycal) AS threshold, "
        "CAST(total >= (SELECT quantile_cont(total, 0.9) FROM daycal) AS INTEGER) AS is_surge, "
        "lag(total) OVER (ORDER BY date) AS lag_1, "
        "CASE WHEN count(*) OVER w = 3 THEN avg(total) OVER w END AS rolling_3_mean FROM daycal "
        "WINDOW w AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) "
        "WHERE rolling_3_mean IS NOT NULL AND lag_1 IS NOT NULL"
    ),
    "zs": (
        "SELECT date, value, (value - m) / sd AS z_score, m FROM daily, "
        "(SELECT avg(value) AS m, stddev_samp(value) AS sd FROM daily)"
    ),
    "iqr": (
        "SELECT date, value, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound "
        "FROM daily, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM daily)"
    ),
    "geo": (
        f"SELECT state, {isum('total')} AS total, count(DISTINCT date) AS active_days, "
        "count(DISTINCT pincode) AS unique_pincodes FROM activity GROUP BY 1"
    ),
    "geodist": (
        f"SELECT district, {isum('total')} AS total, count(DISTINCT date) AS active_days, "
        "count(DISTINCT pincode) AS unique_pincodes FROM segments GROUP BY 1"
    ),
    "pins": (
        "SELECT pincode, state, district, "
        f"{isum('part_a')} AS part_a, {isum('part_b')} AS part_b, {isum('part_c')} AS part_c, "
        f"{isum('total')} AS total, count(DISTINCT date) AS active_days FROM activity GROUP BY 1, 2, 3"
    ),
    "pinscores": (
        "SELECT pincode, state, district, total, active_days, total * 1.0 / active_days AS daily_avg, "
        "(rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0) "
        "/ count(*) OVER () * 100 AS percentile FROM pins"
    ),
    "impact": (
        "SELECT d.date, h.holiday, d.value AS units, b.baseline, "
        "round((d.value - b.baseline) / b.baseline * 100, 2) AS impact_pct, "
        "(SELECT avg(x.value) FROM daily x WHERE x.date >= d.date - 3 AND x.date < d.date) AS avg_before, "
        "(SELECT avg(x.value) FROM daily x WHERE x.date > d.date AND x.date <= d.date + 3) AS avg_after "
        "FROM daily d JOIN holidays h ON d.date = h.date, (SELECT avg(value) AS baseline FROM daily "
        "WHERE date NOT IN (SELECT date FROM holidays)) b"
    ),
    "trended": (
        "SELECT *, value - trend AS detrended, row_number() OVER (ORDER BY date) - 1 AS pos, "
        "count(*) OVER () AS n FROM (SELECT date, value, avg(value) OVER (ORDER BY date "
        "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM daily)"
    ),
    "factors": (
        "SELECT slot, raw - avg(raw) OVER () AS factor FROM (SELECT CAST(pos % 7 AS INTEGER) AS slot, "
        "avg(detrended) AS raw FROM trended GROUP BY 1)"
    ),
    "seasonal": (
        "SELECT step, date, forecast, greatest(0, forecast - 1.96 * sigma) AS lower_bound, "
        "forecast + 1.96 * sigma AS upper_bound FROM (SELECT CAST(i AS INTEGER) AS step, "
        "last_date + CAST(i AS INTEGER) AS date, sigma, "
        "greatest(0, tl + i * (tl - tp) / 7 + factor) AS forecast FROM (SELECT max(date) AS last_date, "
        "max(CASE WHEN n - pos = 1 THEN trend END) AS tl, max(CASE WHEN n - pos = 7 THEN trend END) AS tp, "
        "stddev_pop(detrended) AS sigma FROM trended), range(1, 31) AS r(i), factors "
        "WHERE slot = (isodow(last_date) - 1 + i) % 7)"
    ),
    "vol": (
        f"SELECT state, district, {isum('total')} AS total, avg(total) AS daily_mean, "
        "stddev_samp(total) AS daily_std, count(DISTINCT date) AS active_days, "
        "count(DISTINCT pincode) AS pincodes FROM activity GROUP BY 1, 2"
    ),
    "risk0": "SELECT *, daily_std / daily_mean AS cv0 FROM vol",
    "risk1": (
        "SELECT * EXCLUDE (cv0), CASE WHEN cv0 IS NOT NULL THEN least(cv0, (SELECT quantile_cont(cv0, 0.95) FROM risk0)) END AS cv FROM risk0"
    ),
    "risk2": (
        "SELECT *, (cv - (SELECT min(cv) FROM risk1)) / (SELECT max(cv) - min(cv) FROM risk1) AS cv_normalized, "
        "pincodes * 1.0 / (SELECT max(pincodes) FROM risk1) AS coverage, "
        "total * 1.0 / (SELECT max(total) FROM risk1) AS volume_score FROM risk1"
    ),
    "risk": (
        "SELECT * EXCLUDE (r, n), CASE least(2, floor(3 * (r - 1) / (n - 1))) WHEN 0 THEN 'Low Risk' "
        "WHEN 1 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_category FROM (SELECT *, "
        "row_number() OVER (ORDER BY risk_score, state, district) AS r, count(*) OVER () AS n FROM ("
        "SELECT *, coalesce(cv_normalized, 0.5) * 0.35 + (1 - coverage) * 0.35 + (1 - volume_score) * 0.30 "
        "AS risk_score FROM risk2))"
    ),
    "placed": "SELECT *, CAST(ascii(split_part(district, '/', 2)) AS INTEGER) AS cluster FROM features",
    "profiles": (
        f"SELECT cluster, {isum('total')} AS total_sum, round(avg(total), 2) AS total_mean, "
        "round(avg(pct_a), 2) AS avg_pct_a, round(avg(pct_b), 2) AS avg_pct_b, round(avg(pct_c), 2) AS avg_pct_c, "
        "round(avg(daily_avg), 2) AS avg_daily, count(*) AS count FROM placed GROUP BY 1"
    ),
    "named": (
        "SELECT p.*, CASE WHEN avg_daily > hi THEN 'High Volume' WHEN avg_daily < lo THEN 'Low Volume' "
        "WHEN avg_pct_a > 40 THEN 'Child-Focused' WHEN avg_pct_c > 50 THEN 'Adult-Dominated' "
        "ELSE 'Balanced' END AS cluster_name FROM profiles p, (SELECT quantile_cont(avg_daily, 0.75) AS hi, "
        "quantile_cont(avg_daily, 0.25) AS lo FROM profiles)"
    ),
    "service": (
        "SELECT *, (daily_avg_normalized + coverage_score) / 2 AS service_score FROM (SELECT *, "
        "(daily_avg - min(daily_avg) OVER ()) / (max(daily_avg) OVER () - min(daily_avg) OVER ()) "
        "AS daily_avg_normalized, unique_pincodes * 1.0 / max(unique_pincodes) OVER () AS coverage_score "
        "FROM features)"
    ),
    "overall": (
        "SELECT f.*, total_records, d.*, std_daily_units / avg_daily_units * 100 AS coefficient_of_variation, "
        "total_units * 1.0 / total_states AS units_per_state, total_units * 1.0 / total_districts AS units_per_district, "
        "total_units * 1.0 / total_pincodes AS units_per_pincode FROM "
        f"(SELECT {isum('total')} AS total_units, min(date) AS date_range_start, max(date) AS date_range_end, "
        "count(DISTINCT date) AS total_days, count(DISTINCT state) AS total_states, "
        "count(DISTINCT district) AS total_districts, count(DISTINCT pincode) AS total_pincodes, "
        "sum(part_a) * 100.0 / sum(total) AS pct_age_0_5, sum(part_b) * 100.0 / sum(total) AS pct_age_5_17, "
        "sum(part_c) * 100.0 / sum(total) AS pct_age_18_plus FROM activity) f, "
        "(SELECT count(*) AS total_records FROM activity), "
        "(SELECT avg(value) AS avg_daily_units, median(value) AS median_daily_units, max(value) AS max_daily_units, "
        "min(value) AS min_daily_units, stddev_samp(value) AS std_daily_units FROM daily) d"
    ),
    "by_month": f"SELECT CAST(month(date) AS INTEGER) AS month, {isum('value')} AS value FROM daily GROUP BY 1",
    "by_dow": f"SELECT CAST(isodow(date) - 1 AS INTEGER) AS dow, {isum('value')} AS value FROM daily GROUP BY 1",
    "temporal": (
        "SELECT weekday_avg, weekend_avg, weekend_avg / weekday_avg * 100 AS weekend_efficiency, "
        "(SELECT month FROM by_month ORDER BY value DESC, month LIMIT 1) AS best_month, "
        "(SELECT month FROM by_month ORDER BY value, month LIMIT 1) AS worst_month, "
        "(SELECT dow FROM by_dow ORDER BY value DESC, dow LIMIT 1) AS best_day_of_week, "
        "(SELECT dow FROM by_dow ORDER BY value, dow LIMIT 1) AS worst_day_of_week, "
        "(SELECT stddev_samp(value) / avg(value) * 100 FROM by_month) AS monthly_variance FROM ("
        "SELECT avg(CASE WHEN isodow(date) < 6 THEN value END) AS weekday_avg, "
        "avg(CASE WHEN isodow(date) >= 6 THEN value END) AS weekend_avg FROM daily)"
    ),
    "seasidx": (
        "SELECT month, month_name, total, round(total * 100.0 / avg(total) OVER (), 2) AS seasonality_index FROM ("
        "SELECT CAST(month(date) AS INTEGER) AS month, substr(monthname(date), 1, 3) AS month_name, "
        f"{isum('value')} AS total FROM daily GROUP BY 1, 2)"
    ),
    "dirty": (
        "SELECT date, state, district, pincode, age_0_5, age_5_17, age_18_greater FROM dirty_keyed "
        "UNION ALL SELECT date, state, district, pincode, age_0_5, age_5_17, age_18_greater FROM dirty_keyed "
        "WHERE k % 25 = 7"
    ),
    "dirty_csv": (
        "SELECT date, nullif(state, '') AS state, district, pincode, nullif(age_0_5, '') AS age_0_5, "
        "age_5_17, age_18_greater FROM dirty"
    ),
    "dirty_keyed": (
        "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN '31-02-2025' "
        "WHEN o_orderkey % 50 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') "
        "WHEN o_orderkey % 50 = 2 THEN day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate) "
        "ELSE strftime(o_orderdate, '%d-%m-%Y') END AS date, "
        "CASE WHEN o_orderkey % 40 = 0 THEN 'None' WHEN o_orderkey % 40 = 1 THEN '  ' || lower(n_name) || '* ' "
        "WHEN o_orderkey % 40 = 2 THEN '' WHEN o_orderkey % 40 = 3 THEN '*' ELSE lower(n_name) END AS state, "
        "CASE WHEN o_orderkey % 45 = 0 THEN 'nan' WHEN o_orderkey % 3 = 0 THEN lower(c_mktsegment) || '-EAST' "
        "WHEN o_orderkey % 3 = 1 THEN 'o''' || lower(c_mktsegment) || ' 2nd#' ELSE c_mktsegment END AS district, "
        "CASE WHEN o_custkey % 20 = 0 THEN '1234' WHEN o_custkey % 20 = 1 THEN '12a456' "
        "ELSE CAST(100000 + o_custkey AS VARCHAR) || ' ' END AS pincode, "
        "CASE o_orderkey % 30 WHEN 0 THEN 'abc' WHEN 1 THEN '-5' WHEN 2 THEN '3.7' WHEN 3 THEN '1e3' "
        "WHEN 4 THEN ' 12 ' WHEN 5 THEN '' WHEN 6 THEN 'NaN' WHEN 7 THEN '5d' "
        "ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS age_0_5, "
        "CAST(o_orderkey % 11 AS VARCHAR) AS age_5_17, "
        "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS age_18_greater "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    ),
    "titled": (
        f"SELECT * REPLACE ({title(strip('state'))} AS state, {title(strip('district'))} AS district), "
        "state AS raw_state, district AS raw_district, date AS raw_date, age_0_5 AS raw_count FROM dirty"
    ),
    "nulled": (
        f"SELECT * REPLACE ({null_token('state')} AS state, {null_token('district')} AS district) FROM titled"
    ),
    "names": (
        "SELECT * REPLACE ("
        + strip("regexp_replace(state, '[*?#@!]', '', 'g')") + " AS state, "
        + strip("regexp_replace(district, '[*?#@!]', '', 'g')") + " AS district, "
        "CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date, "
        "CASE WHEN regexp_matches(trim(pincode), '^[0-9]{6}$') THEN trim(pincode) END AS pincode, "
        f"{count('age_0_5')} AS age_0_5, {count('age_5_17')} AS age_5_17, "
        f"{count('age_18_greater')} AS age_18_greater) FROM nulled"
    ),
    "cleaned": (
        f"SELECT *, {calendar('date')}, age_0_5 + age_5_17 + age_18_greater AS total_enrollments FROM ("
        "SELECT DISTINCT date, state, district, pincode, age_0_5, age_5_17, age_18_greater FROM names "
        "WHERE date IS NOT NULL AND state IS NOT NULL AND district IS NOT NULL)"
    ),
    "raw_minimum": (
        "SELECT *, age_0_5 + age_5_17 + age_18_greater AS total_enrollments, "
        "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, "
        "CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, dayname(date) AS day_name, "
        "monthname(date) AS month_name, CAST(quarter(date) AS INTEGER) AS quarter FROM ("
        "SELECT * REPLACE (CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date, "
        f"CAST(trunc({number('age_0_5')}) AS BIGINT) AS age_0_5, "
        f"CAST(trunc({number('age_5_17')}) AS BIGINT) AS age_5_17, "
        f"CAST(trunc({number('age_18_greater')}) AS BIGINT) AS age_18_greater) FROM dirty_csv)"
    ),
    "long": (
        "SELECT measure, state, value FROM (SELECT 'part_a' AS measure, state, part_a AS value FROM activity "
        "UNION ALL SELECT 'part_b', state, part_b FROM activity UNION ALL SELECT 'part_c', state, part_c FROM activity "
        "UNION ALL SELECT 'total', state, total FROM activity)"
    ),
}



def _needs(sql: str, seen: list[str]) -> None:
    for name in dict.fromkeys(_from_names(sql)):
        if name not in seen:
            _needs(CTES[name], seen)
            seen.append(name)


def _from_names(sql: str) -> list[str]:
    """CTEs a piece of SQL reads: names right after FROM, JOIN or a comma in FROM."""
    found = re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)\b(?!\s*\()", sql)
    return [f for f in found if f in CTES]


def oracle(body: str, doubles: str = "", digits: int = 6) -> str:
    """A full statement: the CTEs the body needs, its doubles rounded."""
    seen: list[str] = []
    _needs(body, seen)
    head = ", ".join(f"{name} AS ({CTES[name]})" for name in seen)
    prefix = f"WITH RECURSIVE {head} " if head else ""
    if doubles:
        cols = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in doubles.split())
        body = f"SELECT * REPLACE ({cols}) FROM ({body})"
    return prefix + body
