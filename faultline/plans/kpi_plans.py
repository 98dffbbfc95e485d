"""Registered KPI / ranking / cross-tab queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import formulas as X
from faultline.operators import kpi
from faultline.plans.catalog import register
from faultline.sources.fixtures import inspections, with_views

Q = X.to_duckdb
NO_DEF_SQL = "(" + ", ".join(f"'{v}'" for v in kpi.NO_DEFECT_LABELS) + ")"
D, U = '"d"', '"u"'


def _rate_sql(d: str = D, u: str = U) -> str:
    return (f"{Q(X.rate_pct(d, u))} AS defect_rate_pct, {Q(X.wilson_lower_pct(d, u))} AS ci_lower, "
            f"{Q(X.wilson_upper_pct(d, u))} AS ci_upper")


# ----------------------------------------------------------------------------- K-2
@register("k02_kpi_totals", with_views(f"""
SELECT inspection_records, u AS units_inspected, d AS defective_units, {_rate_sql()},
       CAST(ts_min AS DATE) AS date_min, CAST(ts_max AS DATE) AS date_max,
       coalesce(CAST(floor((epoch_us(ts_max) - epoch_us(ts_min)) / 86400000000) AS BIGINT) + 1, 1) AS days_span
FROM (SELECT count(*) AS inspection_records, CAST(sum(units_inspected) AS BIGINT) AS u,
             CAST(sum(defect_count) AS BIGINT) AS d, min("timestamp") AS ts_min, max("timestamp") AS ts_max
      FROM inspections)"""))
def k02(spark, sf):
    return kpi.kpi_totals(inspections(spark, sf))


# ----------------------------------------------------------------------------- K-3 / K-4
def _rate_by_sql(key: str) -> str:
    return with_views(f"""
SELECT {key}, d AS defects, u AS units, {_rate_sql()}
FROM (SELECT {key}, CAST(sum(defect_count) AS BIGINT) AS d, CAST(sum(units_inspected) AS BIGINT) AS u
      FROM inspections GROUP BY {key})""")


@register("k03_rate_by_machine", _rate_by_sql("machine_id"))
def k03(spark, sf):
    return kpi.rate_by(inspections(spark, sf), "machine_id")


@register("k04_rate_by_shift", _rate_by_sql("shift"))
def k04(spark, sf):
    return kpi.rate_by(inspections(spark, sf), "shift")


# ----------------------------------------------------------------------------- K-5
@register("k05_highest_risk", with_views(f"""
WITH r AS (
  SELECT 'machine_id' AS dimension, CAST(machine_id AS VARCHAR) AS member, {Q(X.rate_pct(D, U))} AS rate_pct
  FROM (SELECT machine_id, sum(defect_count) AS d, sum(units_inspected) AS u FROM inspections GROUP BY machine_id)
  UNION ALL
  SELECT 'shift', CAST(shift AS VARCHAR), {Q(X.rate_pct(D, U))}
  FROM (SELECT shift, sum(defect_count) AS d, sum(units_inspected) AS u FROM inspections GROUP BY shift)),
k AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY rate_pct DESC, member ASC) AS rk FROM r),
dims AS (SELECT * FROM (VALUES ('machine_id'), ('shift')) v(dimension))
SELECT dims.dimension, coalesce(k.member, 'N/A') AS member, coalesce(k.rate_pct, 0.0) AS rate_pct
FROM dims LEFT JOIN k ON dims.dimension = k.dimension AND k.rk = 1"""))
def k05(spark, sf):
    return kpi.highest_risk(inspections(spark, sf))


# ----------------------------------------------------------------------------- K-6
@register("k06_last_30_days_delta", with_views("""
WITH c AS (SELECT max("timestamp") - INTERVAL 30 DAY AS cutoff FROM inspections),
a AS (
  SELECT sum(CASE WHEN "timestamp" >= cutoff THEN defect_count ELSE 0 END) AS d_recent,
         sum(CASE WHEN "timestamp" >= cutoff THEN units_inspected ELSE 0 END) AS u_recent,
         sum(CASE WHEN "timestamp" < cutoff THEN defect_count ELSE 0 END) AS d_prior,
         sum(CASE WHEN "timestamp" < cutoff THEN units_inspected ELSE 0 END) AS u_prior,
         sum(CASE WHEN "timestamp" < cutoff THEN 1 ELSE 0 END) AS n_prior,
         sum(defect_count) AS d, sum(units_inspected) AS u, max("timestamp") AS ts_max
  FROM inspections, c),
b AS (
  SELECT ts_max - INTERVAL 30 DAY AS cutoff, (n_prior > 0 AND u_prior > 0) AS has_prior_period,
         CASE WHEN n_prior > 0 AND u_prior > 0 THEN
              CASE WHEN u_recent > 0 THEN CAST(d_recent AS DOUBLE) / CAST(u_recent AS DOUBLE) * 1e2
                   ELSE """ + Q(X.rate_pct(D, U)) + """ END END AS _recent,
         CASE WHEN n_prior > 0 AND u_prior > 0 THEN CAST(d_prior AS DOUBLE) / CAST(u_prior AS DOUBLE) * 1e2 END AS _prior
  FROM a)
SELECT cutoff, has_prior_period, """ + Q(X.round_half_up('"_recent"', 6)) + """ AS recent_rate_pct,
       """ + Q(X.round_half_up('"_prior"', 6)) + """ AS prior_rate_pct,
       """ + Q(X.round_half_up('"_recent" - "_prior"', 2)) + """ AS delta_pp_30d
FROM b"""))
def k06(spark, sf):
    return kpi.last_30_days_delta(inspections(spark, sf))


# ----------------------------------------------------------------------------- K-7
def _pareto_sql(no_defect: bool) -> str:
    return with_views(f"""
WITH flag AS (SELECT max(CASE WHEN NOT (lower(trim(defect_type)) IN {NO_DEF_SQL}) THEN 1 ELSE 0 END) AS has_real
              FROM inspections),
r AS (SELECT i.* FROM inspections i, flag WHERE NOT (lower(trim(defect_type)) IN {NO_DEF_SQL}) OR flag.has_real = 0),
top AS (SELECT defect_type, CAST(sum(defect_count) AS BIGINT) AS count FROM r GROUP BY defect_type
        ORDER BY count DESC, defect_type ASC LIMIT 5),
t AS (SELECT defect_type, count, sum(count) OVER () AS _tot,
             sum(count) OVER (ORDER BY count DESC, defect_type ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _cum
      FROM top),
u AS (SELECT *, CASE WHEN _tot > 0 THEN _tot ELSE 1 END AS _den FROM t)
SELECT defect_type, count,
       {Q(X.round_half_up('CAST("count" AS DOUBLE) / CAST("_den" AS DOUBLE) * 1e2', 1))} AS pct,
       {Q(X.round_half_up('CAST("_cum" AS DOUBLE) / CAST("_den" AS DOUBLE) * 1e2', 1))} AS cumulative_pct
FROM u""", no_defect_label=no_defect)


@register("k07_pareto_top5", _pareto_sql(False))
def k07(spark, sf):
    return kpi.pareto(inspections(spark, sf))


@register("k07b_pareto_top5_no_defect_labels", _pareto_sql(True))
def k07b(spark, sf):
    return kpi.pareto(inspections(spark, sf, no_defect_label=True))


# ----------------------------------------------------------------------------- K-8
def _type_rank_sql(no_defect: bool) -> str:
    return with_views(f"""
WITH g AS (SELECT defect_type, CAST(sum(defect_count) AS BIGINT) AS d, CAST(sum(units_inspected) AS BIGINT) AS u,
                  count(*) AS record_count FROM inspections GROUP BY defect_type),
t AS (SELECT sum(defect_count) AS _tot FROM inspections),
o AS (SELECT defect_type, d AS defect_count, u AS units_inspected, record_count, {_rate_sql()},
             {Q(X.round_half_up(X.safe_div('"d" * 1e2', '"_tot"', '0e0'), 2))} AS share_of_total_defects_pct,
             lower(trim(defect_type)) IN {NO_DEF_SQL} AS is_no_defect
      FROM g, t)
SELECT *, CASE WHEN NOT is_no_defect THEN row_number() OVER (PARTITION BY is_no_defect
          ORDER BY defect_count DESC, defect_rate_pct DESC, defect_type) END AS rank
FROM o""", no_defect_label=no_defect)


@register("k08_defect_type_ranking", _type_rank_sql(False))
def k08(spark, sf):
    return kpi.defect_type_ranking(inspections(spark, sf))


@register("k08b_defect_type_ranking_no_defect_labels", _type_rank_sql(True))
def k08b(spark, sf):
    return kpi.defect_type_ranking(inspections(spark, sf, no_defect_label=True))


# ----------------------------------------------------------------------------- K-9..K-11
def _cross_sql(a: str, b: str, first: int | None = None) -> str:
    tail = f" ORDER BY {a}, {b} LIMIT {first}" if first else ""
    return with_views(f"""
SELECT {a}, {b}, d AS defects, u AS units,
       {Q(X.round_half_up(X.safe_div('"d" * 1e2', '"u"'), 2))} AS defect_rate_pct
FROM (SELECT {a}, {b}, CAST(sum(defect_count) AS BIGINT) AS d, CAST(sum(units_inspected) AS BIGINT) AS u
      FROM inspections GROUP BY {a}, {b}){tail}""")


@register("k09_machine_x_defect_type", _cross_sql("machine_id", "defect_type"))
def k09(spark, sf):
    return kpi.cross_tab(inspections(spark, sf), "machine_id", "defect_type")


@register("k10_shift_x_defect_type", _cross_sql("shift", "defect_type"))
def k10(spark, sf):
    return kpi.cross_tab(inspections(spark, sf), "shift", "defect_type")


@register("k11_batch_x_defect_type_first20", _cross_sql("batch_id", "defect_type", 20))
def k11(spark, sf):
    return kpi.cross_tab(inspections(spark, sf), "batch_id", "defect_type", first=20)


# ----------------------------------------------------------------------------- K-12 / K-13 / K-25
def _ranking_sql(key: str, count_col: str) -> str:
    return with_views(f"""
WITH g AS (SELECT CAST({key} AS VARCHAR) AS {key}, CAST(sum(defect_count) AS BIGINT) AS d,
                  CAST(sum(units_inspected) AS BIGINT) AS u, count({count_col}) AS inspection_count
           FROM inspections GROUP BY {key}),
o AS (SELECT {key}, d AS defect_count, u AS units_inspected, inspection_count, {_rate_sql()} FROM g)
SELECT *,
       concat({key}, ': ', {Q(X.fixed_text('"defect_rate_pct"', 2))}, '% defect rate (',
              format('{{:,}}', defect_count), ' defects / ', format('{{:,}}', units_inspected), ' inspected, n=',
              format('{{:,}}', units_inspected), ')') AS display_summary,
       row_number() OVER (ORDER BY defect_rate_pct DESC, {key}) AS risk_rank,
       CASE WHEN row_number() OVER (ORDER BY defect_rate_pct DESC, {key}) = 1 THEN 'Highest-risk'
            ELSE 'Normal operation' END AS status
FROM o""")


@register("k12_machine_ranking", _ranking_sql("machine_id", "inspection_id"))
def k12(spark, sf):
    return kpi.member_ranking(inspections(spark, sf), "machine_id", "inspection_id")


@register("k13_shift_ranking", _ranking_sql("shift", "defect_count"))
def k13(spark, sf):
    return kpi.member_ranking(inspections(spark, sf), "shift", "defect_count")


# ----------------------------------------------------------------------------- K-14
PARAM_LIST = ["temperature", "pressure", "speed", "vibration", "humidity"]


def _unpivot_sql(cols=PARAM_LIST) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS parameter, CAST({c} AS DOUBLE) AS v, defect_count, units_inspected FROM inspections "
        f"WHERE {c} IS NOT NULL" for c in cols)


@register("k14_parameter_contrast", with_views(f"""
WITH long AS ({_unpivot_sql()}),
q AS (SELECT parameter, quantile_cont(v, 0.9) AS thr FROM long GROUP BY parameter),
ov AS (SELECT CAST(sum(defect_count) AS DOUBLE) / CAST(sum(units_inspected) AS DOUBLE) * 1e2 AS overall FROM inspections),
g AS (SELECT l.parameter, count(*) AS n, min(q.thr) AS thr,
             sum(CASE WHEN v > thr THEN defect_count ELSE 0 END) AS d_hi,
             sum(CASE WHEN v > thr THEN units_inspected ELSE 0 END) AS u_hi,
             sum(CASE WHEN NOT (v > thr) THEN defect_count ELSE 0 END) AS d_lo,
             sum(CASE WHEN NOT (v > thr) THEN units_inspected ELSE 0 END) AS u_lo,
             avg(CASE WHEN defect_count > 0 THEN v END) AS m_def, avg(CASE WHEN defect_count = 0 THEN v END) AS m_good,
             avg(v) AS m_all
      FROM long l JOIN q ON l.parameter = q.parameter GROUP BY l.parameter),
h AS (SELECT g.*, {Q(X.safe_div('"d_hi" * 1e2', '"u_hi"', '0e0'))} AS hr,
             {Q(X.safe_div('"d_lo" * 1e2', '"u_lo"', '0e0'))} AS lr, ov.overall FROM g, ov),
k AS (SELECT h.*, CASE WHEN lr > 0 THEN hr / lr WHEN overall > 0 THEN hr / overall ELSE 1.0 END AS lift_raw,
             n >= 5 AS avail FROM h),
names AS (SELECT * FROM (VALUES ('temperature'), ('pressure'), ('speed'), ('vibration'), ('humidity')) v(parameter))
SELECT names.parameter,
       CASE WHEN avail THEN 'Available' ELSE 'Data unavailable' END AS status,
       coalesce(avail, false) AS has_data,
       CASE WHEN avail THEN {Q(X.round_half_up('"thr"', 6))} END AS threshold_q90,
       CASE WHEN avail THEN {Q(X.round_half_up('coalesce("m_def", "m_all")', 4))} END AS mean_in_defects,
       CASE WHEN avail THEN {Q(X.round_half_up('coalesce("m_good", "m_all")', 4))} END AS mean_in_good,
       CASE WHEN avail THEN {Q(X.round_half_up('"hr"', 6))} END AS high_threshold_rate_pct,
       CASE WHEN avail THEN {Q(X.round_half_up('"lr"', 6))} END AS baseline_rate_pct,
       CASE WHEN avail THEN {Q(X.round_half_up('"lift_raw"', 6))} END AS lift,
       CASE WHEN avail THEN upper(names.parameter[1]) || names.parameter[2:] || ' > ' || {Q(X.fixed_text('"thr"', 2))}
            || ' is associated with a ' || {Q(X.fixed_text('"hr"', 2))} || '% defect rate (' || {Q(X.fixed_text('"lift_raw"', 2))}
            || 'x lift vs baseline ' || {Q(X.fixed_text('"lr"', 2))} || '%).' END AS finding
FROM names LEFT JOIN k ON names.parameter = k.parameter"""))
def k14(spark, sf):
    return kpi.parameter_contrast(inspections(spark, sf))


# ----------------------------------------------------------------------------- K-15
@register("k15_machine_shift_heatmap", with_views(f"""
WITH g AS (SELECT machine_id, shift, {Q(X.rate_pct(D, U))} AS defect_rate_pct
           FROM (SELECT machine_id, shift, sum(defect_count) AS d, sum(units_inspected) AS u
                 FROM inspections GROUP BY machine_id, shift))
SELECT *, min(defect_rate_pct) OVER () AS min_rate_pct, max(defect_rate_pct) OVER () AS max_rate_pct FROM g"""))
def k15(spark, sf):
    return kpi.heatmap(inspections(spark, sf))


# ----------------------------------------------------------------------------- K-16 / K-19
# Columns that the fixture's pivots have; the queries take every value that the data holds.
SHIFTS = ["1", "2", "3", "4", "5"]
MACHINES = ["M01", "M02", "M03", "M04", "M05"]


def _pivot_sql(row: str, colname: str, values: list[str], row_expr: str | None = None) -> str:
    row_expr = row_expr or row
    cells = ", ".join(
        f"coalesce(max(CASE WHEN {colname} = '{v}' THEN r END), 0.0) AS \"{v}\"" for v in values)
    return with_views(f"""
WITH g AS (SELECT {row}, {colname}, {Q(X.rate_pct(D, U, 6))} AS r
           FROM (SELECT {row_expr} AS {row}, {colname}, sum(defect_count) AS d, sum(units_inspected) AS u
                 FROM inspections GROUP BY 1, 2))
SELECT {row}, {cells} FROM g GROUP BY {row}""")


@register("k16_machine_shift_pivot", _pivot_sql("machine_id", "shift", SHIFTS))
def k16(spark, sf):
    return kpi.pivot_rates(inspections(spark, sf), "machine_id", "shift")


@register("k19_wide_daily_machine_series", _pivot_sql("date", "machine_id", MACHINES,
                                                      row_expr='CAST("timestamp" AS DATE)'))
def k19(spark, sf):
    df = inspections(spark, sf).withColumn("date", F.to_date("timestamp"))
    return kpi.pivot_rates(df, "date", "machine_id")


# ----------------------------------------------------------------------------- K-17 / K-18 / T-1
def _daily_sql(key: str | None) -> str:
    k = f", {key}" if key else ""
    return with_views(f"""
SELECT date{k}, units, defects,
       {Q(X.rate('"defects"', '"units"'))} AS defect_rate,
       {Q(X.round_half_up(X.safe_div('"defects" * 1e2', '"units"'), 2))} AS defect_rate_pct
FROM (SELECT CAST("timestamp" AS DATE) AS date{k}, CAST(sum(units_inspected) AS BIGINT) AS units,
             CAST(sum(defect_count) AS BIGINT) AS defects FROM inspections GROUP BY 1{', 2' if key else ''})""")


@register("k17_daily_rate_by_machine", _daily_sql("machine_id"))
def k17(spark, sf):
    return kpi.daily_rate(inspections(spark, sf), "machine_id")


@register("k18_daily_rate_by_shift", _daily_sql("shift"))
def k18(spark, sf):
    return kpi.daily_rate(inspections(spark, sf), "shift")


@register("t01_daily_series", _daily_sql(None))
def t01(spark, sf):
    return kpi.daily_rate(inspections(spark, sf), None)


# ----------------------------------------------------------------------------- K-20 / K-21
def _batch_sql(flagged_only: bool) -> str:
    where = " WHERE flagged = 1" if flagged_only else ""
    return with_views(f"""
WITH ov AS (SELECT {Q(X.safe_div('sum(defect_count)', 'sum(units_inspected)', '0e0'))} AS _overall FROM inspections),
g AS (SELECT part_lot AS batch_id, CAST(sum(defect_count) AS BIGINT) AS defects,
             CAST(sum(units_inspected) AS BIGINT) AS units, list_sort(list_distinct(list(machine_id))) AS _m,
             min("timestamp") AS _t0, max("timestamp") AS _t1 FROM inspections GROUP BY part_lot),
o AS (SELECT batch_id, {Q(X.round_half_up(X.safe_div('"defects" * 1e2', '"units"'), 2))} AS defect_rate_pct,
             defects, units,
             CASE WHEN {Q(X.round_half_up(X.safe_div('"defects" * 1e2', '"units"'), 2))} > _overall * 100.0 * 1.3
                  THEN 1 ELSE 0 END AS flagged,
             concat(strftime(_t0, '%Y-%m-%d'), ' → ', strftime(_t1, '%Y-%m-%d')) AS date_range,
             array_to_string(list_slice(_m, 1, 3), ',') AS machines,
             {Q(X.round_half_up('"_overall" * 1e2', 2))} AS global_rate_pct
      FROM g, ov)
SELECT * FROM o{where}""")


@register("k20_batch_table", _batch_sql(False))
def k20(spark, sf):
    return kpi.batch_table(inspections(spark, sf, with_part_lot=True), batch_col="part_lot")


@register("k21_flagged_batches", _batch_sql(True))
def k21(spark, sf):
    return kpi.flagged_batches(kpi.batch_table(inspections(spark, sf, with_part_lot=True), batch_col="part_lot"))


# ----------------------------------------------------------------------------- K-22 / K-23 / K-24
@register("k22_machine_rollup_top_type", with_views(f"""
WITH mt AS (SELECT machine_id, defect_type, sum(defect_count) AS d, sum(units_inspected) AS u
            FROM inspections GROUP BY machine_id, defect_type),
top AS (SELECT machine_id, defect_type AS top_defect_type,
               row_number() OVER (PARTITION BY machine_id ORDER BY d DESC, defect_type) AS rk FROM mt),
g AS (SELECT machine_id, CAST(sum(d) AS BIGINT) AS defects, CAST(sum(u) AS BIGINT) AS units FROM mt GROUP BY machine_id)
SELECT g.machine_id, defects, units, top_defect_type, {Q(X.rate_pct('"defects"', '"units"'))} AS defect_rate_pct
FROM g JOIN top ON g.machine_id = top.machine_id AND top.rk = 1"""))
def k22(spark, sf):
    return kpi.machine_rollup(inspections(spark, sf))


@register("k23_shift_defect_mix", with_views(f"""
WITH st AS (SELECT shift, defect_type, CAST(sum(defect_count) AS BIGINT) AS d, sum(units_inspected) AS u
            FROM inspections GROUP BY shift, defect_type),
top AS (SELECT shift, defect_type AS top_defect_type,
               row_number() OVER (PARTITION BY shift ORDER BY d DESC, defect_type) AS rk FROM st),
tot AS (SELECT shift, sum(d) AS sd, sum(u) AS su FROM st GROUP BY shift)
SELECT st.shift, st.defect_type, st.d AS defects,
       {Q(X.round_half_up(X.safe_div('"d" * 1e2', '"sd"', '0e0'), 2))} AS share_pct,
       top.top_defect_type, {Q(X.rate_pct('"sd"', '"su"'))} AS shift_rate_pct
FROM st JOIN tot ON st.shift = tot.shift JOIN top ON st.shift = top.shift AND top.rk = 1"""))
def k23(spark, sf):
    return kpi.shift_mix(inspections(spark, sf))


@register("k24_distinct_defect_types", with_views("SELECT DISTINCT defect_type FROM inspections"))
def k24(spark, sf):
    return kpi.distinct_types(inspections(spark, sf))
