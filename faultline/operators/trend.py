"""Trend and change detection.

The heavy step — rows → (series key, period) sums — is an ordinary distributed
aggregate.  What follows runs on the per-period series, which has one row per period
(months / weeks / days of the observed span) and therefore stays small however many
inspections there are: each series is folded in one row with higher-order functions
(``aggregate`` / ``transform``), one task per series key.  EWMA and CUSUM are
non-associative recurrences, so they are folds, not window aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import formulas as X

EWMA_SPAN = 7.0            # fixed: alpha = 2 / (span + 1) = 0.25
BASELINE_WINDOW = 14       # fixed: trailing baseline periods (upper bound of b)
CUSUM_K = 0.5              # fixed: allowance
CUSUM_H = 5.0              # fixed: decision threshold
SPIKE_Z = 3.0              # fixed: |z| above this is a spike
HALF_FACTOR = 1.15         # fixed: half-mean ratio for increasing / decreasing


def grain_of(df: DataFrame) -> Column:
    """'month' if the span exceeds 180 days, 'week' from 30 days, else 'day' (scalar subquery)."""
    span = df.agg(
        (F.floor((F.unix_micros(F.max("timestamp").cast("timestamp"))
                  - F.unix_micros(F.min("timestamp").cast("timestamp"))) / F.lit(86_400_000_000)) + 1)
        .alias("span")).scalar()
    return F.when(span > 180, "month").when(span >= 30, "week").otherwise("day")


def period_columns(grain: Column) -> list[Column]:
    ts = F.col("timestamp")
    start = (F.when(grain == "month", F.to_date(F.date_trunc("month", ts)))
              .when(grain == "week", F.to_date(F.date_trunc("week", ts)))
              .otherwise(F.to_date(ts)))
    return [start.alias("period_start"), grain.alias("grain")]


def period_sums(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """T-2: (keys, period) → units, defects, rate = defects / (units or 1)."""
    g = df.select(*keys, "units_inspected", "defect_count", *period_columns(grain_of(df)))
    agg = g.groupBy(*keys, "period_start", "grain").agg(
        F.sum("units_inspected").alias("units"), F.sum("defect_count").alias("defects"))
    label = (F.when(F.col("grain") == "month", F.date_format("period_start", "yyyy-MM"))
              .when(F.col("grain") == "week",
                    F.concat(F.date_format("period_start", "yyyy-MM-dd"), F.lit("/"),
                             F.date_format(F.date_add("period_start", 6), "yyyy-MM-dd")))
              .otherwise(F.date_format("period_start", "yyyy-MM-dd")))
    return agg.select(*keys, label.alias("period"), "period_start", "units", "defects",
                      X.spark("CAST(`defects` AS DOUBLE) / CAST(CASE WHEN `units` = 0 THEN 1 ELSE `units` END AS DOUBLE)")
                      .alias("defect_rate"))


def _fold_exprs() -> dict[str, str]:
    """Spark SQL higher-order expressions over ``pts`` (sorted array of period structs)."""
    n = "size(pts)"
    b = f"greatest(2, least({BASELINE_WINDOW}, greatest(2, CAST(floor({n} / 2) AS INT))))"
    r = "transform(pts, p -> p.defect_rate)"
    alpha = X.lit(2.0 / (EWMA_SPAN + 1.0))
    keep = X.lit(1.0 - 2.0 / (EWMA_SPAN + 1.0))
    ewma = (f"aggregate(r, CAST(array() AS ARRAY<DOUBLE>), (acc, x) -> concat(acc, array("
            f"CASE WHEN size(acc) = 0 THEN x ELSE {keep} * element_at(acc, -1) + {alpha} * x END)))")
    # trailing window of the b previous rates: mean and sample std, summed in order
    win = "slice(r, i - b + 1, b)"
    mean = f"(aggregate({win}, 0e0, (a, x) -> a + x) / CAST(b AS DOUBLE))"
    sd = f"sqrt(aggregate({win}, 0e0, (a, x) -> a + (x - {mean}) * (x - {mean})) / CAST(b - 1 AS DOUBLE))"
    zraw = f"(CASE WHEN {sd} > 0e0 THEN (r[i] - {mean}) / {sd} ELSE 0e0 END)"
    z = f"transform(sequence(0, size(r) - 1), i -> CASE WHEN i >= b THEN {zraw} ELSE NULL END)"
    return dict(n=n, b=b, r=r, ewma=ewma, z=z)


def trend_series(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """T-2..T-6 per series: period, units, defects, rate, EWMA, z (trend: 0-filled;
    CUSUM: null before b), spike flag, S+, S-, CUSUM flag, plus ``idx`` and ``b``."""
    s = period_sums(df, keys)
    folded = s.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("period_start", "period", "units", "defects", "defect_rate"))).alias("pts"))
    e = _fold_exprs()
    k, h = X.lit(CUSUM_K), X.lit(CUSUM_H)
    folded = (folded.withColumn("b", F.expr(e["b"]))
                    .withColumn("r", F.expr(e["r"]))
                    .withColumn("ewma", F.expr(e["ewma"]))
                    .withColumn("z", F.expr(e["z"])))
    # two-sided CUSUM from index b; all zeros when the series is shorter than b + 1
    cusum = (f"aggregate(z, named_struct('sp', 0e0, 'sm', 0e0, 'a', CAST(array() AS ARRAY<STRUCT<sp: DOUBLE, sm: DOUBLE>>)), "
             f"(acc, x) -> CASE WHEN x IS NULL THEN named_struct('sp', acc.sp, 'sm', acc.sm, "
             f"'a', concat(acc.a, array(named_struct('sp', 0e0, 'sm', 0e0)))) ELSE "
             f"named_struct('sp', greatest(0e0, acc.sp + x - {k}), 'sm', greatest(0e0, acc.sm - x - {k}), "
             f"'a', concat(acc.a, array(named_struct('sp', greatest(0e0, acc.sp + x - {k}), "
             f"'sm', greatest(0e0, acc.sm - x - {k}))))) END).a")
    folded = folded.withColumn("cs", F.expr(cusum))
    out = folded.select(*keys, "b", F.posexplode("pts").alias("idx", "pt"),
                        "ewma", "z", "cs", F.size("pts").alias("n"))
    zi = F.col("z")[F.col("idx")]
    short = F.col("n") < F.col("b") + 1
    return out.select(
        *keys, F.col("idx").cast("bigint").alias("idx"), F.col("b").cast("bigint").alias("b"),
        "pt.period", "pt.period_start", "pt.units", "pt.defects", "pt.defect_rate",
        F.col("ewma")[F.col("idx")].alias("ewma"),
        F.coalesce(zi, F.lit(0.0)).alias("z_trend"),
        F.when(F.abs(F.coalesce(zi, F.lit(0.0))) > SPIKE_Z, 1).otherwise(0).alias("spike_flag"),
        F.when(short, F.lit(0.0)).otherwise(zi).alias("z_cusum"),
        F.when(short, F.lit(0.0)).otherwise(F.col("cs")[F.col("idx")]["sp"]).alias("cusum_pos"),
        F.when(short, F.lit(0.0)).otherwise(F.col("cs")[F.col("idx")]["sm"]).alias("cusum_neg"),
    ).withColumn("cusum_flag", F.when((F.col("cusum_pos") > CUSUM_H) | (F.col("cusum_neg") > CUSUM_H), 1)
                 .otherwise(0))


def change_points(series: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """T-7: first flagged period per series — date, direction, mean rate of up to 14
    previous periods, mean rate from the change on, signed CUSUM value."""
    pts = series.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("idx", "defect_rate"))).alias("rs"),
        F.min(F.when(F.col("cusum_flag") == 1, F.col("idx"))).alias("cp_idx"))
    cp = series.where(F.col("cusum_flag") == 1).groupBy(*keys).agg(
        F.min_by(F.struct("idx", "period", "period_start", "cusum_pos", "cusum_neg"), F.col("idx")).alias("c")
    ).where(F.col("c").isNotNull())          # a global aggregate yields one row even without flags
    j = cp.join(pts, list(keys), "inner") if keys else \
        cp.withColumn("_one", F.lit(1)).join(pts.withColumn("_one", F.lit(1)), "_one")
    before = ("aggregate(slice(transform(rs, x -> x.defect_rate), greatest(1, CAST(cp_idx AS INT) - "
              f"{BASELINE_WINDOW} + 1), CAST(cp_idx AS INT) - greatest(0, CAST(cp_idx AS INT) - {BASELINE_WINDOW})), "
              "0e0, (a, x) -> a + x) / CAST(CAST(cp_idx AS INT) - greatest(0, CAST(cp_idx AS INT) - "
              f"{BASELINE_WINDOW}) AS DOUBLE)")
    after = ("aggregate(slice(transform(rs, x -> x.defect_rate), CAST(cp_idx AS INT) + 1, size(rs)), 0e0, "
             "(a, x) -> a + x) / CAST(size(rs) - CAST(cp_idx AS INT) AS DOUBLE)")
    up = F.col("c.cusum_pos") > CUSUM_H
    return j.select(
        *keys, F.col("c.idx").alias("cp_index"), F.col("c.period").alias("cp_period"),
        F.col("c.period_start").alias("cp_date"),
        F.when(up, "up").otherwise("down").alias("direction"),
        X.spark(X.round_half_up(before, 8)).alias("before_rate"),
        X.spark(X.round_half_up(after, 8)).alias("after_rate"),
        X.spark(X.round_half_up("CASE WHEN `c`.`cusum_pos` > 5e0 THEN `c`.`cusum_pos` ELSE -`c`.`cusum_neg` END", 6))
        .alias("cusum_value"))


def before_after(df: DataFrame, change_date: str) -> DataFrame:
    """T-8: rate, rows, defects before (<) and from (>=) ``change_date``; pp and % change."""
    cut = F.to_timestamp_ntz(F.lit(change_date))
    pre = F.col("timestamp") < cut
    post = F.col("timestamp") >= cut
    t = df.agg(
        F.sum(F.when(pre, F.col("defect_count")).otherwise(0)).alias("d_before"),
        F.sum(F.when(pre, F.col("units_inspected")).otherwise(0)).alias("u_before"),
        F.sum(F.when(pre, 1).otherwise(0)).alias("inspections_before"),
        F.sum(F.when(post, F.col("defect_count")).otherwise(0)).alias("d_after"),
        F.sum(F.when(post, F.col("units_inspected")).otherwise(0)).alias("u_after"),
        F.sum(F.when(post, 1).otherwise(0)).alias("inspections_after"))
    rb = X.rate("`d_before`", "`u_before`")
    ra = X.rate("`d_after`", "`u_after`")
    return t.select(
        X.spark(X.round_half_up(rb, 8)).alias("before_rate"), "inspections_before",
        F.col("d_before").alias("defective_before"),
        X.spark(X.round_half_up(ra, 8)).alias("after_rate"), "inspections_after",
        F.col("d_after").alias("defective_after"),
        X.spark(X.round_half_up(f"({ra} - {rb}) * 1e2", 2)).alias("absolute_change_pp"),
        X.spark(f"CASE WHEN {rb} > 0e0 THEN {X.round_half_up(f'({ra} - {rb}) / {rb} * 1e2', 1)} ELSE 0e0 END")
        .alias("relative_change_pct"))


def before_after_by(df: DataFrame, change_date: str, key: str, min_rows: int = 10) -> DataFrame:
    """T-9: per group with >= ``min_rows`` rows on both sides: both rates %, lift."""
    cut = F.to_timestamp_ntz(F.lit(change_date))
    pre = F.col("timestamp") < cut
    g = df.groupBy(key).agg(
        F.sum(F.when(pre, F.col("defect_count")).otherwise(0)).alias("d1"),
        F.sum(F.when(pre, F.col("units_inspected")).otherwise(0)).alias("u1"),
        F.sum(F.when(pre, 1).otherwise(0)).alias("n1"),
        F.sum(F.when(~pre, F.col("defect_count")).otherwise(0)).alias("d2"),
        F.sum(F.when(~pre, F.col("units_inspected")).otherwise(0)).alias("u2"),
        F.sum(F.when(~pre, 1).otherwise(0)).alias("n2"))
    r1, r2 = X.rate("`d1`", "`u1`"), X.rate("`d2`", "`u2`")
    return g.where((F.col("n1") >= min_rows) & (F.col("n2") >= min_rows)).select(
        F.col(key).cast("string").alias(key),
        X.spark(X.round_half_up(f"{r1} * 1e2", 2)).alias("before_rate"),
        X.spark(X.round_half_up(f"{r2} * 1e2", 2)).alias("after_rate"),
        X.spark(f"CASE WHEN {r1} > 0e0 THEN {X.round_half_up(f'{r2} / {r1}', 2)} END").alias("lift"))


# What is said of series without and with one period.
EMPTY_SERIES = "Insufficient data for trend interpretation."
SHORT_SERIES = "Inspection volume is uniform across the observation window."


def interpretation(series: DataFrame, cps: DataFrame) -> DataFrame:
    """T-10: one sentence per series: change point if any, else half-mean comparison
    (x1.15) — increasing / decreasing / stable — with the (first) peak period."""
    s = series.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("idx", "period", "defect_rate"))).alias("pts"))
    n = "size(pts)"
    half = f"greatest(1, CAST(floor({n} / 2) AS INT))"
    r = "transform(pts, p -> p.defect_rate)"
    first = f"(aggregate(slice({r}, 1, {half}), 0e0, (a, x) -> a + x) / CAST({half} AS DOUBLE))"
    second = f"try_divide(aggregate(slice({r}, {half} + 1, {n}), 0e0, (a, x) -> a + x), CAST({n} - {half} AS DOUBLE))"
    mean = f"try_divide(aggregate({r}, 0e0, (a, x) -> a + x), CAST({n} AS DOUBLE))"
    peak = "aggregate(pts, get(pts, 0), (a, p) -> CASE WHEN p.defect_rate > a.defect_rate THEN p ELSE a END)"
    s = s.select(F.expr(n).alias("n"), F.expr(first).alias("h1"), F.expr(second).alias("h2"),
                 F.expr(mean).alias("m"), F.expr(peak).alias("peak"))
    s = s.withColumn("_one", F.lit(1)).join(
        cps.select("cp_date", "before_rate", "after_rate", "cusum_value").withColumn("_one", F.lit(1)), "_one", "left")
    pct = lambda c: X.spark(X.fixed_text(f"({c}) * 1e2", 2))
    trend = (F.when(F.col("h2") > F.col("h1") * HALF_FACTOR, "increasing")
              .when(F.col("h1") > F.col("h2") * HALF_FACTOR, "decreasing").otherwise("stable"))
    kind = F.when(F.col("n") < 2, "insufficient").when(F.col("cp_date").isNotNull(), "change_point").otherwise(trend)
    peak_txt = F.concat(F.lit("The peak defect rate of "), pct("`peak`.`defect_rate`"), F.lit("% occurred on "),
                        F.col("peak.period"), F.lit("."))
    text = (F.when(F.col("n") == 0, EMPTY_SERIES).when(F.col("n") == 1, SHORT_SERIES)
             .when(F.col("cp_date").isNotNull(), F.concat(
                F.lit("A change-point was detected on "), F.date_format("cp_date", "yyyy-MM-dd"),
                F.lit(" (CUSUM shift score "), X.spark(X.fixed_text("`cusum_value`", 1)), F.lit("). Defect rate shifted from "),
                pct("`before_rate`"), F.lit("% prior to "), pct("`after_rate`"), F.lit("% following the shift. "), peak_txt))
             .when(kind == "increasing", F.concat(
                F.lit("Defect rates increased during the latter portion of the observation window (second-half average "),
                pct("`h2`"), F.lit("% vs first-half average "), pct("`h1`"), F.lit("%). "), peak_txt))
             .when(kind == "decreasing", F.concat(
                F.lit("Defect rates decreased over the observation window (first-half average "), pct("`h1`"),
                F.lit("% vs second-half average "), pct("`h2`"), F.lit("%). The highest historical defect rate of "),
                pct("`peak`.`defect_rate`"), F.lit("% occurred on "), F.col("peak.period"), F.lit(".")))
             .otherwise(F.concat(
                F.lit("Defect rates remained stable across the observation window (average "), pct("`m`"),
                F.lit("%). Minor variation peaked at "), pct("`peak`.`defect_rate`"), F.lit("% on "),
                F.col("peak.period"), F.lit("."))))
    return s.select(kind.alias("trend"), F.col("peak.period").alias("peak_period"),
                    X.spark(X.round_half_up("`peak`.`defect_rate`", 8)).alias("peak_rate"), text.alias("text"))
