"""Registered trend / change-detection queries and their SQL oracles.

The oracles fold the per-period series with DuckDB list lambdas (EWMA, trailing
mean / std) and a recursive CTE (CUSUM), i.e. an independent statement of the same
recurrences in another engine.
"""

from __future__ import annotations

from faultline.functions import formulas as X
from faultline.operators import trend
from faultline.plans.catalog import register
from faultline.sources.fixtures import event_inspections, inspections, with_views

Q = X.to_duckdb
CHANGE_DATE = "1998-01-01"      # split date of the fixture's before / after panel
EVENT_CHANGE_DATE = "2024-01-15"


def _series_ctes(source: str = "inspections", key: str | None = None) -> str:
    """CTEs ending in ``zt``: one row per (key, period) with idx, b, rate, ewma, z, plus
    ``cs``: the CUSUM recursion."""
    kc = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    grp = f"GROUP BY {key}" if key else ""
    join_k = f"AND c.{key} = zt.{key}" if key else ""
    return f"""
span AS (SELECT floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 86400000000) + 1 AS span FROM {source}),
gr AS (SELECT CASE WHEN span > 180 THEN 'month' WHEN span >= 30 THEN 'week' ELSE 'day' END AS grain FROM span),
p AS (SELECT {kc}CASE WHEN grain = 'month' THEN CAST(date_trunc('month', "timestamp") AS DATE)
                    WHEN grain = 'week' THEN CAST(date_trunc('week', "timestamp") AS DATE)
                    ELSE CAST("timestamp" AS DATE) END AS period_start, grain, units_inspected, defect_count
      FROM {source}, gr),
s AS (SELECT {kc}period_start, grain, CAST(sum(units_inspected) AS BIGINT) AS units,
             CAST(sum(defect_count) AS BIGINT) AS defects FROM p GROUP BY {kc}period_start, grain),
s2 AS (SELECT {kc}CASE WHEN grain = 'month' THEN strftime(period_start, '%Y-%m')
                     WHEN grain = 'week' THEN concat(strftime(period_start, '%Y-%m-%d'), '/',
                                                     strftime(period_start + INTERVAL 6 DAY, '%Y-%m-%d'))
                     ELSE strftime(period_start, '%Y-%m-%d') END AS period,
              period_start, units, defects,
              CAST(defects AS DOUBLE) / CAST(CASE WHEN units = 0 THEN 1 ELSE units END AS DOUBLE) AS defect_rate,
              row_number() OVER ({part}ORDER BY period_start) - 1 AS idx
       FROM s),
arr AS (SELECT {kc}list(defect_rate ORDER BY idx) AS r, count(*) AS n FROM s2 {grp}),
bb AS (SELECT {kc}r, n, greatest(2, least(14, greatest(2, CAST(floor(n / 2) AS INTEGER)))) AS b,
              list_reduce(r, lambda acc, x: list_append(acc, CASE WHEN len(acc) = 0 THEN x
                          ELSE 7.5e-1 * acc[-1] + 2.5e-1 * x END), []::DOUBLE[]) AS ew
       FROM arr),
zt AS (SELECT s2.*, bb.b, bb.n, bb.ew[s2.idx + 1] AS ewma,
              CASE WHEN s2.idx >= bb.b THEN (
                 WITH w AS (SELECT list_slice(bb.r, CAST(s2.idx - bb.b + 1 AS BIGINT), CAST(s2.idx AS BIGINT)) AS win),
                 m AS (SELECT win, list_reduce(win, lambda a, x: a + x, 0e0) / CAST(bb.b AS DOUBLE) AS mean FROM w),
                 sd AS (SELECT mean, sqrt(list_reduce(win, lambda a, x: a + (x - mean) * (x - mean), 0e0)
                                        / CAST(bb.b - 1 AS DOUBLE)) AS sd FROM m)
                 SELECT CASE WHEN sd > 0e0 THEN (s2.defect_rate - mean) / sd ELSE 0e0 END FROM sd)
              END AS z
       FROM s2 JOIN bb ON {'s2.' + key + ' = bb.' + key if key else 'true'}),
cs AS (
  WITH RECURSIVE c({kc}idx, sp, sm) AS (
    SELECT {kc}-1 AS idx, 0e0 AS sp, 0e0 AS sm FROM bb
    UNION ALL
    SELECT {'c.' + key + ', ' if key else ''}c.idx + 1,
           CASE WHEN zt.z IS NULL THEN c.sp ELSE greatest(0e0, c.sp + zt.z - 5e-1) END,
           CASE WHEN zt.z IS NULL THEN c.sm ELSE greatest(0e0, c.sm - zt.z - 5e-1) END
    FROM c JOIN zt ON zt.idx = c.idx + 1 {join_k})
  SELECT * FROM c WHERE idx >= 0),
full_series AS (
  SELECT zt.*, coalesce(z, 0e0) AS z_trend,
         CASE WHEN abs(coalesce(z, 0e0)) > 3e0 THEN 1 ELSE 0 END AS spike_flag,
         CASE WHEN n < b + 1 THEN 0e0 ELSE z END AS z_cusum,
         CASE WHEN n < b + 1 THEN 0e0 ELSE cs.sp END AS cusum_pos,
         CASE WHEN n < b + 1 THEN 0e0 ELSE cs.sm END AS cusum_neg
  FROM zt JOIN cs ON cs.idx = zt.idx {'AND cs.' + key + ' = zt.' + key if key else ''}),
fs AS (SELECT *, CASE WHEN cusum_pos > 5e0 OR cusum_neg > 5e0 THEN 1 ELSE 0 END AS cusum_flag FROM full_series)"""


def _r(x: str, n: int = 8) -> str:
    return Q(X.round_half_up(x, n))


def _series_sql(cols: str, source="inspections", key=None, events=False) -> str:
    return with_views(f"WITH {_series_ctes(source, key)}\nSELECT {cols} FROM fs", events=events)


# ------------------------------------------------------------------ T-2
@register("t02_adaptive_grain_trend", _series_sql(
    "idx, period, period_start, units, defects, defect_rate"))
def t02(spark, sf):
    return trend.trend_series(inspections(spark, sf)).select(
        "idx", "period", "period_start", "units", "defects", "defect_rate")


@register("t02b_event_daily_trend", _series_sql(
    "idx, period, period_start, units, defects, defect_rate", source="event_inspections", events=True))
def t02b(spark, sf):
    return trend.trend_series(event_inspections(spark, sf)).select(
        "idx", "period", "period_start", "units", "defects", "defect_rate")


# ------------------------------------------------------------------ T-3
@register("t03_ewma", _series_sql(f"idx, period, {_r('ewma', 10)} AS ewma"))
def t03(spark, sf):
    s = trend.trend_series(inspections(spark, sf))
    return s.select("idx", "period", X.spark(X.round_half_up("`ewma`", 10)).alias("ewma"))


# ------------------------------------------------------------------ T-4 / T-5
@register("t04_rolling_zscore_spikes", _series_sql(
    f"idx, period, CAST(b AS BIGINT) AS b, {_r('z_trend', 6)} AS z_trend, spike_flag"))
def t04(spark, sf):
    s = trend.trend_series(inspections(spark, sf))
    return s.select("idx", "period", "b", X.spark(X.round_half_up("`z_trend`", 6)).alias("z_trend"), "spike_flag")


@register("t05_spike_periods", _series_sql("idx, period, defect_rate, spike_flag") + " WHERE spike_flag = 1")
def t05(spark, sf):
    s = trend.trend_series(inspections(spark, sf))
    return s.where("spike_flag = 1").select("idx", "period", "defect_rate", "spike_flag")


# ------------------------------------------------------------------ T-6
@register("t06_cusum", _series_sql(
    f"idx, period, {_r('z_cusum', 6)} AS z_cusum, {_r('cusum_pos', 6)} AS cusum_pos, "
    f"{_r('cusum_neg', 6)} AS cusum_neg, cusum_flag"))
def t06(spark, sf):
    s = trend.trend_series(inspections(spark, sf))
    return s.select("idx", "period", X.spark(X.round_half_up("`z_cusum`", 6)).alias("z_cusum"),
                    X.spark(X.round_half_up("`cusum_pos`", 6)).alias("cusum_pos"),
                    X.spark(X.round_half_up("`cusum_neg`", 6)).alias("cusum_neg"), "cusum_flag")


# ------------------------------------------------------------------ T-7
def _cp_sql(key: str | None = None, source="inspections", events=False) -> str:
    kc = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    on = f"f.{key} = r.{key}" if key else "true"
    return with_views(f"""WITH {_series_ctes(source, key)},
first_cp AS (SELECT * FROM (SELECT fs.*, row_number() OVER ({part}ORDER BY idx) AS rk FROM fs WHERE cusum_flag = 1)
             WHERE rk = 1),
rr AS (SELECT {kc}list(defect_rate ORDER BY idx) AS r FROM fs {'GROUP BY ' + key if key else ''})
SELECT {'f.' + key + ', ' if key else ''}f.idx AS cp_index, f.period AS cp_period, f.period_start AS cp_date,
       CASE WHEN f.cusum_pos > 5e0 THEN 'up' ELSE 'down' END AS direction,
       {_r('list_reduce(list_slice(r.r, greatest(1, f.idx - 14 + 1), f.idx), lambda a, x: a + x, 0e0) / CAST(f.idx - greatest(0, f.idx - 14) AS DOUBLE)')} AS before_rate,
       {_r('list_reduce(list_slice(r.r, f.idx + 1, len(r.r)), lambda a, x: a + x, 0e0) / CAST(len(r.r) - f.idx AS DOUBLE)')} AS after_rate,
       {_r('CASE WHEN f.cusum_pos > 5e0 THEN f.cusum_pos ELSE -f.cusum_neg END', 6)} AS cusum_value
FROM first_cp f JOIN rr r ON {on}""", events=events)


@register("t07_change_point", _cp_sql())
def t07(spark, sf):
    return trend.change_points(trend.trend_series(inspections(spark, sf)))


# ------------------------------------------------------------------ T-8 / T-9
def _ba_sql(source: str, cut: str, events: bool) -> str:
    rb = 'CASE WHEN u_before > 0 THEN CAST(d_before AS DOUBLE) / CAST(u_before AS DOUBLE) ELSE NULL END'
    ra = 'CASE WHEN u_after > 0 THEN CAST(d_after AS DOUBLE) / CAST(u_after AS DOUBLE) ELSE NULL END'
    return with_views(f"""
WITH t AS (SELECT CAST(sum(CASE WHEN "timestamp" < TIMESTAMP '{cut}' THEN defect_count ELSE 0 END) AS BIGINT) AS d_before,
                  sum(CASE WHEN "timestamp" < TIMESTAMP '{cut}' THEN units_inspected ELSE 0 END) AS u_before,
                  CAST(sum(CASE WHEN "timestamp" < TIMESTAMP '{cut}' THEN 1 ELSE 0 END) AS BIGINT) AS inspections_before,
                  CAST(sum(CASE WHEN "timestamp" >= TIMESTAMP '{cut}' THEN defect_count ELSE 0 END) AS BIGINT) AS d_after,
                  sum(CASE WHEN "timestamp" >= TIMESTAMP '{cut}' THEN units_inspected ELSE 0 END) AS u_after,
                  CAST(sum(CASE WHEN "timestamp" >= TIMESTAMP '{cut}' THEN 1 ELSE 0 END) AS BIGINT) AS inspections_after
           FROM {source})
SELECT {_r(rb)} AS before_rate, inspections_before, d_before AS defective_before,
       {_r(ra)} AS after_rate, inspections_after, d_after AS defective_after,
       {_r(f'({ra} - {rb}) * 1e2', 2)} AS absolute_change_pp,
       CASE WHEN {rb} > 0e0 THEN {_r(f'({ra} - {rb}) / {rb} * 1e2', 1)} ELSE 0e0 END AS relative_change_pct
FROM t""", events=events)


@register("t08_before_after_panel", _ba_sql("inspections", CHANGE_DATE, False))
def t08(spark, sf):
    return trend.before_after(inspections(spark, sf), CHANGE_DATE)


@register("t08b_event_before_after_panel", _ba_sql("event_inspections", EVENT_CHANGE_DATE, True))
def t08b(spark, sf):
    return trend.before_after(event_inspections(spark, sf), EVENT_CHANGE_DATE)


def _ba_group_sql(key: str, source: str, cut: str, events: bool) -> str:
    r1 = 'CASE WHEN u1 > 0 THEN CAST(d1 AS DOUBLE) / CAST(u1 AS DOUBLE) ELSE NULL END'
    r2 = 'CASE WHEN u2 > 0 THEN CAST(d2 AS DOUBLE) / CAST(u2 AS DOUBLE) ELSE NULL END'
    return with_views(f"""
WITH g AS (SELECT {key}, sum(CASE WHEN "timestamp" < TIMESTAMP '{cut}' THEN defect_count ELSE 0 END) AS d1,
                  sum(CASE WHEN "timestamp" < TIMESTAMP '{cut}' THEN units_inspected ELSE 0 END) AS u1,
                  sum(CASE WHEN "timestamp" < TIMESTAMP '{cut}' THEN 1 ELSE 0 END) AS n1,
                  sum(CASE WHEN NOT ("timestamp" < TIMESTAMP '{cut}') THEN defect_count ELSE 0 END) AS d2,
                  sum(CASE WHEN NOT ("timestamp" < TIMESTAMP '{cut}') THEN units_inspected ELSE 0 END) AS u2,
                  sum(CASE WHEN NOT ("timestamp" < TIMESTAMP '{cut}') THEN 1 ELSE 0 END) AS n2
           FROM {source} GROUP BY {key})
SELECT CAST({key} AS VARCHAR) AS {key}, {_r(f'{r1} * 1e2', 2)} AS before_rate, {_r(f'{r2} * 1e2', 2)} AS after_rate,
       CASE WHEN {r1} > 0e0 THEN {_r(f'{r2} / {r1}', 2)} END AS lift
FROM g WHERE n1 >= 10 AND n2 >= 10""", events=events)


@register("t09_before_after_by_machine", _ba_group_sql("machine_id", "inspections", CHANGE_DATE, False))
def t09(spark, sf):
    return trend.before_after_by(inspections(spark, sf), CHANGE_DATE, "machine_id")


@register("t09b_event_before_after_by_shift", _ba_group_sql("shift", "event_inspections", EVENT_CHANGE_DATE, True))
def t09b(spark, sf):
    return trend.before_after_by(event_inspections(spark, sf), EVENT_CHANGE_DATE, "shift")


# ------------------------------------------------------------------ T-10
def _pct_sql(x: str) -> str:
    return Q(X.fixed_text(f"({x}) * 1e2", 2))


def _t10_sql() -> str:
    before = _r('list_reduce(list_slice(r.r, greatest(1, f.idx - 14 + 1), f.idx), lambda a, x: a + x, 0e0) / CAST(f.idx - greatest(0, f.idx - 14) AS DOUBLE)')
    after = _r('list_reduce(list_slice(r.r, f.idx + 1, len(r.r)), lambda a, x: a + x, 0e0) / CAST(len(r.r) - f.idx AS DOUBLE)')
    cusum = _r('CASE WHEN f.cusum_pos > 5e0 THEN f.cusum_pos ELSE -f.cusum_neg END', 6)
    return with_views(f"""WITH {_series_ctes()},
first_cp AS (SELECT * FROM (SELECT fs.*, row_number() OVER (ORDER BY idx) AS rk FROM fs WHERE cusum_flag = 1) WHERE rk = 1),
rr AS (SELECT list(defect_rate ORDER BY idx) AS r, list(period ORDER BY idx) AS per, count(*) AS n FROM fs),
cpv AS (SELECT f.period_start AS cp_date, {before} AS before_rate, {after} AS after_rate, {cusum} AS cusum_value
        FROM first_cp f, rr r),
st AS (SELECT n, greatest(1, CAST(floor(n / 2) AS INTEGER)) AS half, r, per FROM rr),
st2 AS (SELECT *, list_reduce(list_slice(r, 1, half), lambda a, x: a + x, 0e0) / CAST(half AS DOUBLE) AS h1,
               list_reduce(list_slice(r, half + 1, n), lambda a, x: a + x, 0e0) / CAST(n - half AS DOUBLE) AS h2,
               list_reduce(r, lambda a, x: a + x, 0e0) / CAST(n AS DOUBLE) AS m,
               list_max(r) AS peak_rate, per[list_position(r, list_max(r))] AS peak_period FROM st),
k AS (SELECT st2.*, cpv.*, CASE WHEN cp_date IS NOT NULL THEN 'change_point'
                                WHEN h2 > h1 * 1.15e0 THEN 'increasing' WHEN h1 > h2 * 1.15e0 THEN 'decreasing'
                                ELSE 'stable' END AS trend
      FROM st2 LEFT JOIN cpv ON true)
SELECT trend, peak_period, {_r('peak_rate', 8)} AS peak_rate,
       CASE WHEN trend = 'change_point' THEN 'A change-point was detected on ' || strftime(cp_date, '%Y-%m-%d')
              || ' (CUSUM shift score ' || {Q(X.fixed_text('"cusum_value"', 1))} || '). Defect rate shifted from '
              || {_pct_sql('"before_rate"')} || '% prior to ' || {_pct_sql('"after_rate"')}
              || '% following the shift. The peak defect rate of ' || {_pct_sql('"peak_rate"')} || '% occurred on '
              || peak_period || '.'
            WHEN trend = 'increasing' THEN 'Defect rates increased during the latter portion of the observation window (second-half average '
              || {_pct_sql('"h2"')} || '% vs first-half average ' || {_pct_sql('"h1"')} || '%). The peak defect rate of '
              || {_pct_sql('"peak_rate"')} || '% occurred on ' || peak_period || '.'
            WHEN trend = 'decreasing' THEN 'Defect rates decreased over the observation window (first-half average '
              || {_pct_sql('"h1"')} || '% vs second-half average ' || {_pct_sql('"h2"')}
              || '%). The highest historical defect rate of ' || {_pct_sql('"peak_rate"')} || '% occurred on '
              || peak_period || '.'
            ELSE 'Defect rates remained stable across the observation window (average ' || {_pct_sql('"m"')}
              || '%). Minor variation peaked at ' || {_pct_sql('"peak_rate"')} || '% on ' || peak_period || '.' END AS text
FROM k""")


@register("t10_trend_interpretation", _t10_sql())
def t10(spark, sf):
    df = inspections(spark, sf)
    s = trend.trend_series(df)
    return trend.interpretation(s, trend.change_points(s))


# ------------------------------------------------------------------ T-11
@register("t11_change_points_by_machine", _cp_sql("machine_id"))
def t11(spark, sf):
    s = trend.trend_series(inspections(spark, sf), keys=("machine_id",))
    return trend.change_points(s, keys=("machine_id",))


@register("t11b_cusum_by_machine", _series_sql(
    f"machine_id, idx, period, {_r('cusum_pos', 6)} AS cusum_pos, {_r('cusum_neg', 6)} AS cusum_neg, cusum_flag",
    key="machine_id"))
def t11b(spark, sf):
    s = trend.trend_series(inspections(spark, sf), keys=("machine_id",))
    return s.select("machine_id", "idx", "period", X.spark(X.round_half_up("`cusum_pos`", 6)).alias("cusum_pos"),
                    X.spark(X.round_half_up("`cusum_neg`", 6)).alias("cusum_neg"), "cusum_flag")
