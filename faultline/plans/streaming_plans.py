"""Registered streaming jobs: each drains the ``events`` file stream with
``trigger(availableNow=True)`` into a parquet sink and returns the sink.  The oracles
state the append-mode contract: a window is emitted once the watermark
(max event time − 1 hour) has passed its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import formulas as X
from faultline.plans.catalog import register
from faultline.sources.fixtures import with_views
from faultline.streaming import jobs as J

Q = X.to_duckdb
RATE = Q(X.rate('"defects"', '"units"'))


@register("st01_tumbling_daily_rate_by_machine", with_views(f"""
WITH g AS (SELECT time_bucket(INTERVAL 1 DAY, "timestamp") AS window_start, machine_id,
                  CAST(sum(units_inspected) AS BIGINT) AS units, CAST(sum(defect_count) AS BIGINT) AS defects
           FROM event_inspections GROUP BY 1, 2),
wm AS (SELECT max("timestamp") - INTERVAL 1 HOUR AS wm FROM event_inspections)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, machine_id, units, defects, {RATE} AS defect_rate
FROM g, wm WHERE window_start + INTERVAL 1 DAY <= wm""", events=True))
def st01(spark, sf):
    out = J.run_to_parquet(J.tumbling_rate(J.event_stream(spark, sf)), "st01")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "machine_id", "units", "defects", "defect_rate")


@register("st02_sliding_30_day_rate", with_views(f"""
WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, "timestamp") AS d, units_inspected, defect_count FROM event_inspections),
x AS (SELECT d - k * INTERVAL 1 DAY AS window_start, units_inspected, defect_count FROM e, range(0, 30) t(k)),
g AS (SELECT window_start, CAST(sum(units_inspected) AS BIGINT) AS units, CAST(sum(defect_count) AS BIGINT) AS defects
      FROM x GROUP BY 1),
wm AS (SELECT max("timestamp") - INTERVAL 1 HOUR AS wm FROM event_inspections)
SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, units, defects, {RATE} AS defect_rate
FROM g, wm WHERE window_start + INTERVAL 30 DAY <= wm""", events=True))
def st02(spark, sf):
    out = J.run_to_parquet(J.sliding_rate(J.event_stream(spark, sf)), "st02")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "units", "defects", "defect_rate")


@register("st03_dedup_within_watermark", with_views(
    "SELECT DISTINCT inspection_id, machine_id, defect_count FROM event_inspections", events=True))
def st03(spark, sf):
    twice = J.event_stream(spark, sf).unionByName(J.event_stream(spark, sf))   # every id arrives twice
    out = J.run_to_parquet(J.dedup_ids(twice), "st03")
    return out.select("inspection_id", "machine_id", "defect_count")


def _r6(c: str) -> str:
    return Q(X.round_half_up(c, 6))


@register("st04_online_cusum_alerts", with_views(f"""
WITH d AS (SELECT machine_id, CAST("timestamp" AS DATE) AS day, CAST(sum(units_inspected) AS BIGINT) AS units,
                  CAST(sum(defect_count) AS BIGINT) AS defects FROM event_inspections GROUP BY 1, 2),
d2 AS (SELECT *, CASE WHEN units > 0 THEN CAST(defects AS DOUBLE) / CAST(units AS DOUBLE) ELSE 0e0 END AS rate,
              row_number() OVER (PARTITION BY machine_id ORDER BY day) - 1 AS idx,
              count(*) OVER (PARTITION BY machine_id) AS n FROM d),
closed AS (SELECT * FROM d2 WHERE day + INTERVAL 1 DAY <= (SELECT max("timestamp") - INTERVAL 1 HOUR FROM event_inspections)),
arr AS (SELECT machine_id, list(rate ORDER BY idx) AS r FROM closed GROUP BY machine_id),
zt AS (SELECT c.*, CASE WHEN c.idx >= {J.Z_WINDOW} THEN (
           WITH w AS (SELECT list_slice(a.r, CAST(c.idx - {J.Z_WINDOW} + 1 AS BIGINT), CAST(c.idx AS BIGINT)) AS win),
           m AS (SELECT win, list_reduce(win, lambda s, x: s + x, 0e0) / {X.lit(float(J.Z_WINDOW))} AS mu FROM w),
           sd AS (SELECT mu, sqrt(list_reduce(win, lambda s, x: s + (x - mu) * (x - mu), 0e0)
                                  / {X.lit(float(J.Z_WINDOW - 1))}) AS sd FROM m)
           SELECT CASE WHEN sd > 0e0 THEN (c.rate - mu) / sd ELSE 0e0 END FROM sd) END AS z
       FROM closed c JOIN arr a USING (machine_id)),
cs AS (
  WITH RECURSIVE k(machine_id, idx, sp, sm) AS (
    SELECT machine_id, -1, 0e0, 0e0 FROM arr
    UNION ALL
    SELECT k.machine_id, k.idx + 1,
           CASE WHEN zt.z IS NULL THEN k.sp ELSE greatest(0e0, k.sp + zt.z - 5e-1) END,
           CASE WHEN zt.z IS NULL THEN k.sm ELSE greatest(0e0, k.sm - zt.z - 5e-1) END
    FROM k JOIN zt ON zt.machine_id = k.machine_id AND zt.idx = k.idx + 1)
  SELECT * FROM k WHERE idx >= 0)
SELECT zt.machine_id, day, units, defects, rate AS defect_rate, {_r6('"z"')} AS z,
       {_r6('cs.sp')} AS cusum_pos, {_r6('cs.sm')} AS cusum_neg,
       CAST(CASE WHEN cs.sp > 5e0 OR cs.sm > 5e0 THEN 1 ELSE 0 END AS INTEGER) AS alert
FROM zt JOIN cs ON cs.machine_id = zt.machine_id AND cs.idx = zt.idx""", events=True))
def st04(spark, sf):
    out = J.run_to_parquet(J.online_cusum(J.event_stream(spark, sf)), "st04")
    return out.select("machine_id", "day", "units", "defects", "defect_rate",
                      X.spark(X.round_half_up("`z`", 6)).alias("z"),
                      X.spark(X.round_half_up("`cusum_pos`", 6)).alias("cusum_pos"),
                      X.spark(X.round_half_up("`cusum_neg`", 6)).alias("cusum_neg"), "alert")
