"""Rates, KPIs, rankings and cross-tabs over the canonical inspection table.

Every operator is one declarative plan: a scan, a (partial + final) hash aggregate on
its keys, and expressions.  Totals that a grouped result is compared with (overall
rate, total defects, max timestamp) are uncorrelated scalar subqueries: Spark runs
them once as a separate one-row job and inlines the value, so no join and no
single-partition window over row-level data appears in any plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import formulas as X
from faultline.functions.quantile import exact_quantiles
from faultline.sources.fixtures import PARAMS

# Defect-type labels that mean "no defect" (compared after lower()+trim()).
NO_DEFECT_LABELS = ("no defect", "nodefect", "no_defect", "pass", "ok", "no defective", "none", "good")

D, U = "`d`", "`u`"


def is_no_defect(c: str = "defect_type"):
    return F.lower(F.trim(F.col(c))).isin(*NO_DEFECT_LABELS)


def _rate_cols(d: str = D, u: str = U, digits: int = 2) -> list:
    return [X.spark(X.rate_pct(d, u, digits)).alias("defect_rate_pct"),
            X.spark(X.wilson_lower_pct(d, u, digits)).alias("ci_lower"),
            X.spark(X.wilson_upper_pct(d, u, digits)).alias("ci_upper")]


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("defect_count").alias("d"), F.sum("units_inspected").alias("u"))


def kpi_totals(df: DataFrame) -> DataFrame:
    """K-2: one row — records, units, defects, rate with Wilson CI, date range, days span."""
    t = df.agg(F.count(F.lit(1)).alias("inspection_records"),
               F.sum("units_inspected").alias("u"), F.sum("defect_count").alias("d"),
               F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"))
    span = F.floor((F.unix_micros(F.col("ts_max").cast("timestamp"))
                    - F.unix_micros(F.col("ts_min").cast("timestamp"))) / F.lit(86_400_000_000)) + 1
    return t.select(
        "inspection_records",
        F.col("u").alias("units_inspected"), F.col("d").alias("defective_units"),
        *_rate_cols(),
        F.to_date("ts_min").alias("date_min"), F.to_date("ts_max").alias("date_max"),
        F.coalesce(span.cast("bigint"), F.lit(1).cast("bigint")).alias("days_span"))


def rate_by(df: DataFrame, key: str) -> DataFrame:
    """K-3 / K-4: Σd, Σu, rate and Wilson CI per member of ``key``."""
    return _sums(df, key).select(key, F.col("d").alias("defects"), F.col("u").alias("units"), *_rate_cols())


def highest_risk(df: DataFrame, dims=("machine_id", "shift")) -> DataFrame:
    """K-5: per dimension the member with the highest 2-dp rate; ties go to the first key
    in sorted order; 'N/A' with rate 0 when the table is empty."""
    parts = []
    for dim in dims:
        r = _sums(df, dim).select(F.lit(dim).alias("dimension"), F.col(dim).cast("string").alias("member"),
                                  X.spark(X.rate_pct(D, U)).alias("rate_pct"))
        parts.append(r)
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    # one row per member: rank within the dimension (rate desc, then member name)
    w = Window.partitionBy("dimension").orderBy(F.col("rate_pct").desc(), F.col("member").asc())
    ranked = allr.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")
    dims_df = df.sparkSession.createDataFrame([(d,) for d in dims], "dimension string")
    return (dims_df.join(ranked, "dimension", "left")
            .select("dimension", F.coalesce("member", F.lit("N/A")).alias("member"),
                    F.coalesce("rate_pct", F.lit(0.0)).alias("rate_pct")))


def last_30_days_delta(df: DataFrame, days: int = 30) -> DataFrame:
    """K-6: rate in the last ``days`` days (ts >= max - days) vs before; delta in pp."""
    max_ts = df.agg(F.max("timestamp")).scalar()
    cutoff = max_ts - F.expr(f"INTERVAL {days} DAYS")
    recent = F.col("timestamp") >= cutoff
    prior = F.col("timestamp") < cutoff
    t = df.agg(
        F.sum(F.when(recent, F.col("defect_count")).otherwise(0)).alias("d_recent"),
        F.sum(F.when(recent, F.col("units_inspected")).otherwise(0)).alias("u_recent"),
        F.sum(F.when(prior, F.col("defect_count")).otherwise(0)).alias("d_prior"),
        F.sum(F.when(prior, F.col("units_inspected")).otherwise(0)).alias("u_prior"),
        F.sum(F.when(prior, 1).otherwise(0)).alias("n_prior"),
        F.sum("defect_count").alias("d"), F.sum("units_inspected").alias("u"),
        F.max("timestamp").alias("ts_max"))
    has_prior = (F.col("n_prior") > 0) & (F.col("u_prior") > 0)
    recent_pct = F.when(F.col("u_recent") > 0, F.col("d_recent") / F.col("u_recent") * 100.0) \
        .otherwise(X.spark(X.rate_pct(D, U)))
    prior_pct = F.col("d_prior") / F.col("u_prior") * 100.0
    delta = X.spark(X.round_half_up("`_delta`", 2))
    return (t.select(
        (F.col("ts_max") - F.expr(f"INTERVAL {days} DAYS")).alias("cutoff"),
        has_prior.alias("has_prior_period"),
        F.when(has_prior, recent_pct).alias("_recent"),
        F.when(has_prior, prior_pct).alias("_prior"))
        .withColumn("_delta", F.col("_recent") - F.col("_prior"))
        .select("cutoff", "has_prior_period",
                X.spark(X.round_half_up("`_recent`", 6)).alias("recent_rate_pct"),
                X.spark(X.round_half_up("`_prior`", 6)).alias("prior_rate_pct"),
                delta.alias("delta_pp_30d")))


def pareto(df: DataFrame, n: int = 5) -> DataFrame:
    """K-7: top-n real defect types by Σd; pct and running pct of the top-n total (1 dp).
    Falls back to all rows when every row carries a no-defect label."""
    has_real = df.agg(F.max(F.when(~is_no_defect(), 1).otherwise(0))).scalar()
    real = df.where(~is_no_defect() | (has_real == 0))
    top = (real.groupBy("defect_type").agg(F.sum("defect_count").alias("count"))
               .orderBy(F.col("count").desc(), F.col("defect_type").asc()).limit(n))
    w_all = Window.partitionBy(F.lit(1))   # over <= n rows: the top-n result only
    w_run = Window.partitionBy(F.lit(1)).orderBy(F.col("count").desc(), F.col("defect_type").asc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (top.withColumn("_tot", F.sum("count").over(w_all))
            .withColumn("_cum", F.sum("count").over(w_run))
            .withColumn("_den", F.when(F.col("_tot") > 0, F.col("_tot")).otherwise(F.lit(1))))
    return t.select("defect_type", "count",
                    X.spark(X.round_half_up("CAST(`count` AS DOUBLE) / CAST(`_den` AS DOUBLE) * 1e2", 1)).alias("pct"),
                    X.spark(X.round_half_up("CAST(`_cum` AS DOUBLE) / CAST(`_den` AS DOUBLE) * 1e2", 1))
                    .alias("cumulative_pct"))


def defect_type_ranking(df: DataFrame) -> DataFrame:
    """K-8: per type Σd, Σu, rows, rate + CI, share of all defects, no-defect flag, rank
    among real types (Σd desc, rate desc, name) — rank 1 is the dominant type."""
    total_d = df.agg(F.sum("defect_count")).scalar()
    g = df.groupBy("defect_type").agg(F.sum("defect_count").alias("d"), F.sum("units_inspected").alias("u"),
                                      F.count(F.lit(1)).alias("record_count"))
    g = g.withColumn("_tot", total_d)
    out = g.select(
        "defect_type", F.col("d").alias("defect_count"), F.col("u").alias("units_inspected"), "record_count",
        *_rate_cols(),
        X.spark(X.safe_div("`d` * 1e2", "`_tot`", "0e0")).alias("_share"),
        is_no_defect().alias("is_no_defect"))
    out = out.withColumn("share_of_total_defects_pct", X.spark(X.round_half_up("`_share`", 2))).drop("_share")
    w = Window.partitionBy("is_no_defect").orderBy(F.col("defect_count").desc(),
                                                   F.col("defect_rate_pct").desc(), F.col("defect_type"))
    return out.withColumn("rank", F.when(~F.col("is_no_defect"), F.row_number().over(w)).cast("bigint"))


def cross_tab(df: DataFrame, a: str, b: str, first: int | None = None) -> DataFrame:
    """K-9 / K-10 / K-11: Σd, Σu and rate % (2 dp) per (a, b); ``first`` keeps the first
    rows in key order (the batch table shows 20)."""
    g = _sums(df, a, b).select(a, b, F.col("d").alias("defects"), F.col("u").alias("units"),
                               X.spark(X.round_half_up(X.safe_div("`d` * 1e2", "`u`"), 2)).alias("defect_rate_pct"))
    if first is not None:
        g = g.orderBy(a, b).limit(first)
    return g


def member_ranking(df: DataFrame, key: str, count_col: str) -> DataFrame:
    """K-12 / K-13: Σd, Σu, inspections, rate + CI, display text, rank by rate desc."""
    g = df.groupBy(key).agg(F.sum("defect_count").alias("d"), F.sum("units_inspected").alias("u"),
                            F.count(count_col).alias("inspection_count"))
    out = g.select(F.col(key).cast("string").alias(key), F.col("d").alias("defect_count"),
                   F.col("u").alias("units_inspected"), "inspection_count", *_rate_cols())
    text = F.format_string("%s: %s%% defect rate (%s defects / %s inspected, n=%s)", F.col(key),
                           X.spark(X.fixed_text("`defect_rate_pct`", 2)),
                           F.format_number("defect_count", 0), F.format_number("units_inspected", 0),
                           F.format_number("units_inspected", 0))
    w = Window.orderBy(F.col("defect_rate_pct").desc(), F.col(key))   # one row per member: small
    return (out.withColumn("display_summary", text)
               .withColumn("risk_rank", F.row_number().over(w).cast("bigint"))
               .withColumn("status", F.when(F.col("risk_rank") == 1, "Highest-risk").otherwise("Normal operation")))


# The sentence about a parameter, as text and the number behind it.
CONTRAST_FINDING = [(" > ", "thr"), (" is associated with a ", "hr"), ("% defect rate (", "lift_raw"),
                    ("x lift vs baseline ", "lr")]
CONTRAST_END = "%)."


def parameter_contrast(df: DataFrame, params=tuple(PARAMS), min_rows: int = 5) -> DataFrame:
    """K-14: per process parameter — p90, rate above vs at/below, mean among defective vs
    good rows, lift; 'Data unavailable' for parameters with < ``min_rows`` values.

    One unpivot job for all parameters; the p90s are exact (bracketed, see quantile.py)."""
    present = [p for p in params if p in df.columns]
    q = exact_quantiles(df, present, 0.9)
    overall = df.agg(F.coalesce(F.try_divide(F.sum("defect_count"), F.sum("units_inspected")) * 100.0, F.lit(0.0))).scalar()
    long = df.select(
        "defect_count", "units_inspected",
        F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("v"))
                            for p in present])).alias("kv")).select("kv.*", "defect_count", "units_inspected")
    thr = F.create_map(*[x for p in present for x in (F.lit(p), F.lit(q[p]))])[F.col("parameter")]
    long = long.where(F.col("v").isNotNull()).withColumn("thr", thr)
    hi = F.col("v") > F.col("thr")
    g = long.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n"), F.first("thr").alias("thr"),
        F.sum(F.when(hi, F.col("defect_count")).otherwise(0)).alias("d_hi"),
        F.sum(F.when(hi, F.col("units_inspected")).otherwise(0)).alias("u_hi"),
        F.sum(F.when(~hi, F.col("defect_count")).otherwise(0)).alias("d_lo"),
        F.sum(F.when(~hi, F.col("units_inspected")).otherwise(0)).alias("u_lo"),
        F.avg(F.when(F.col("defect_count") > 0, F.col("v"))).alias("m_def"),
        F.avg(F.when(F.col("defect_count") == 0, F.col("v"))).alias("m_good"),
        F.avg("v").alias("m_all"))
    hi_rate = X.safe_div("`d_hi` * 1e2", "`u_hi`", "0e0")
    lo_rate = X.safe_div("`d_lo` * 1e2", "`u_lo`", "0e0")
    g = (g.withColumn("hr", X.spark(hi_rate)).withColumn("lr", X.spark(lo_rate))
          .withColumn("overall", F.lit(overall))
          .withColumn("lift_raw", F.when(F.col("lr") > 0, F.col("hr") / F.col("lr"))
                      .when(F.col("overall") > 0, F.col("hr") / F.col("overall")).otherwise(F.lit(1.0))))
    avail = F.col("n") >= min_rows
    names = df.sparkSession.createDataFrame([(p,) for p in params], "parameter string")
    res = g.select(
        "parameter",
        F.when(avail, "Available").otherwise("Data unavailable").alias("status"),
        avail.alias("has_data"),
        F.when(avail, X.spark(X.round_half_up("`thr`", 6))).alias("threshold_q90"),
        F.when(avail, X.spark(X.round_half_up("coalesce(`m_def`, `m_all`)", 4))).alias("mean_in_defects"),
        F.when(avail, X.spark(X.round_half_up("coalesce(`m_good`, `m_all`)", 4))).alias("mean_in_good"),
        F.when(avail, X.spark(X.round_half_up("`hr`", 6))).alias("high_threshold_rate_pct"),
        F.when(avail, X.spark(X.round_half_up("`lr`", 6))).alias("baseline_rate_pct"),
        F.when(avail, X.spark(X.round_half_up("`lift_raw`", 6))).alias("lift"),
        F.when(avail, F.concat(F.initcap("parameter"), *[x for text, c in CONTRAST_FINDING for x in (
            F.lit(text), X.spark(X.fixed_text(f"`{c}`", 2)))], F.lit(CONTRAST_END))).alias("finding"))
    return names.join(res, "parameter", "left").select(
        "parameter", F.coalesce("status", F.lit("Data unavailable")).alias("status"),
        F.coalesce("has_data", F.lit(False)).alias("has_data"), "threshold_q90", "mean_in_defects",
        "mean_in_good", "high_threshold_rate_pct", "baseline_rate_pct", "lift", "finding")


def heatmap(df: DataFrame, a: str = "machine_id", b: str = "shift") -> DataFrame:
    """K-15: rate % per (a, b), 0 without units, plus the global min / max for shading."""
    g = _sums(df, a, b).select(a, b, X.spark(X.rate_pct(D, U)).alias("defect_rate_pct"))
    w = Window.partitionBy(F.lit(1))   # over the (a, b) cells only — a small table
    return g.withColumn("min_rate_pct", F.min("defect_rate_pct").over(w)) \
            .withColumn("max_rate_pct", F.max("defect_rate_pct").over(w))


def pivot_rates(df: DataFrame, row: str, col: str, values: list[str] | None = None) -> DataFrame:
    """K-16 / K-19: rows × column values of the joint rate (missing → 0).

    Without ``values`` every value of ``col`` becomes a column (Spark refuses more than
    ``spark.sql.pivotMaxValues`` of them)."""
    g = _sums(df, row, col)
    p = g.groupBy(row).pivot(col, values).agg(
        F.first(X.spark(X.rate_pct(D, U, 6))))
    return p.fillna(0.0, subset=[c for c in p.columns if c != row])


def daily_rate(df: DataFrame, key: str | None) -> DataFrame:
    """K-17 / K-18 / T-1: (date[, key]) → Σu, Σd, rate."""
    keys = [F.to_date("timestamp").alias("date")] + ([F.col(key)] if key else [])
    g = df.groupBy(*keys).agg(F.sum("units_inspected").alias("units"), F.sum("defect_count").alias("defects"))
    return g.select(*(["date"] + ([key] if key else [])), "units", "defects",
                    X.spark(X.rate("`defects`", "`units`")).alias("defect_rate"),
                    X.spark(X.round_half_up(X.safe_div("`defects` * 1e2", "`units`"), 2)).alias("defect_rate_pct"))


def batch_table(df: DataFrame, batch_col: str = "batch_id", factor: float = 1.3) -> DataFrame:
    """K-20: per batch Σd, Σu, rate, first three sorted machines, date range text,
    flagged = rate (2 dp) > factor × global rate."""
    overall = df.agg(X.spark(X.safe_div("sum(defect_count)", "sum(units_inspected)", "0e0"))).scalar()
    g = df.groupBy(F.col(batch_col).alias("batch_id")).agg(
        F.sum("defect_count").alias("defects"), F.sum("units_inspected").alias("units"),
        F.collect_set("machine_id").alias("_m"),       # bounded by the number of machines
        F.min("timestamp").alias("_t0"), F.max("timestamp").alias("_t1"))
    g = g.withColumn("_overall", overall)
    return g.select(
        "batch_id", X.spark(X.round_half_up(X.safe_div("`defects` * 1e2", "`units`"), 2)).alias("defect_rate_pct"),
        "defects", "units",
        F.when(X.spark(X.round_half_up(X.safe_div("`defects` * 1e2", "`units`"), 2))
               > F.col("_overall") * 100.0 * factor, 1).otherwise(0).alias("flagged"),
        F.concat(F.date_format("_t0", "yyyy-MM-dd"), F.lit(" → "), F.date_format("_t1", "yyyy-MM-dd")).alias("date_range"),
        F.array_join(F.slice(F.array_sort("_m"), 1, 3), ",").alias("machines"),
        X.spark(X.round_half_up("`_overall` * 1e2", 2)).alias("global_rate_pct"))


def machine_rollup(df: DataFrame) -> DataFrame:
    """K-22: per machine Σd, Σu and the type with the most defects (ties: name)."""
    mt = _sums(df, "machine_id", "defect_type")
    return mt.groupBy("machine_id").agg(
        F.sum("d").alias("defects"), F.sum("u").alias("units"),
        F.min(F.struct((-F.col("d")).alias("nd"), F.col("defect_type"))).alias("_top")
    ).select("machine_id", "defects", "units", F.col("_top.defect_type").alias("top_defect_type"),
             X.spark(X.rate_pct("`defects`", "`units`")).alias("defect_rate_pct"))


def shift_mix(df: DataFrame) -> DataFrame:
    """K-23: per (shift, type) share of the shift's defects (%), the shift's top type and rate."""
    st = _sums(df, "shift", "defect_type")
    tot = st.groupBy("shift").agg(F.sum("d").alias("sd"), F.sum("u").alias("su"),
                                  F.min(F.struct((-F.col("d")).alias("nd"), F.col("defect_type"))).alias("_top"))
    return st.join(tot, "shift").select(
        "shift", "defect_type", F.col("d").alias("defects"),
        X.spark(X.round_half_up(X.safe_div("`d` * 1e2", "`sd`", "0e0"), 2)).alias("share_pct"),
        F.col("_top.defect_type").alias("top_defect_type"),
        X.spark(X.rate_pct("`sd`", "`su`")).alias("shift_rate_pct"))


def distinct_types(df: DataFrame) -> DataFrame:
    """K-24: sorted distinct defect types."""
    return df.select("defect_type").distinct()


def flagged_batches(batches: DataFrame) -> DataFrame:
    """K-21: the flagged rows of K-20."""
    return batches.where(F.col("flagged") == 1)
