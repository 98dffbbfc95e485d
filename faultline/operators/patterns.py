"""Multi-factor subgroup ("pattern") mining, depth 1–3.

Plan, all declarative:

1. Exact p90 per process parameter (bracketed quantile, only scalars reach the driver);
   the miner's thresholds are those values at six significant digits.
2. Support floor ``min_units = max(50, int(0.005 * Σu))``.  A slice needs that many units, so
   every grouping column has at most Σu / min_units ≤ 200 qualifying values; values below
   the floor at depth 1 can never be part of a qualifying deeper slice (support is
   monotone) and are mapped to NULL *before* the cube is built — their rows stay in every
   other slice and in the totals.  The keep-lists travel as literals: their size bound is
   proven, not guessed.
3. One scan → a *fine cube* keyed by the pruned dimensions, week and defect type.  It does not
   hold raw categorical values, so it does not grow with the number of batches; everything
   but the affected lists reads the cube.
4. ``GROUPING SETS`` (92 for eight dimensions) over roll-ups of the cube: slices with
   Σu, Σd, rows, dates, parameter sums; again with week in every set (recurrence),
   with defect type (dominant type), and with each raw categorical (affected lists).
   Complement measures are ``total − slice``: no second scan.
5. Statistics are column expressions (formulas.py); rankings use windows over the
   slice table (≤ 200 qualifying slices per combination, ≤ 18,400 in all).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import formulas as X
from faultline.session import materialize
from faultline.functions.quantile import exact_quantiles
from faultline.sources.fixtures import PARAMS

CATS = ["machine_id", "shift", "batch_id"]
# The miner's "no defect" label set (shorter than the KPI one).
MINER_NO_DEFECT = ("no defect", "nodefect", "no_defect", "pass", "ok", "good")
MULTIPLE = "Multiple defect types observed"
DOMINANCE_SHARE = 0.45
WEEK_MIN_UNITS = 50
TOP_TYPES = 3
BATCHES_LISTED = 8
TOP_IDS = 60
SUPPORT_SHARE = 0.005
SUPPORT_MIN = 50


@dataclass
class MiningSpace:
    dims: list[str]            # cube column names, in factor order
    labels: dict[str, str]     # dim → factor key prefix (machine_id, temperature_bucket, ...)
    params: list[str]
    thresholds: dict[str, float]
    min_units: Column          # scalar subquery
    param_sums: dict[str, Column]
    param_counts: dict[str, Column]
    total_u: Column
    total_d: Column
    fine: DataFrame            # pruned fine cube
    base: DataFrame            # rows with pruned dimensions and raw categorical values

    max_depth: int = 3

    @property
    def combos(self) -> list[tuple[str, ...]]:
        """Combinations of dimensions by depth, then in factor order."""
        return [c for k in range(1, min(self.max_depth, len(self.dims)) + 1) for c in itertools.combinations(self.dims, k)]


def dim_name(p: str) -> str:
    return f"hi_{p}"


def mining_space(df: DataFrame, max_depth: int = 3, checkpoint: bool = True,
                 thresholds: dict[str, float | None] | None = None) -> MiningSpace:
    """Pruned dimensions, totals and the stored fine cube.  ``thresholds``: the parameters' p90, if known."""
    params = [p for p in PARAMS if p in df.columns]
    q = thresholds if thresholds is not None else exact_quantiles(df, params, 0.9)
    params = [p for p in params if q.get(p) is not None]
    thr_cols = {p: X.spark(X.sig6(X.lit(q[p]))) for p in params}

    # totals and depth-1 support first, straight from the rows: one aggregate each
    tot = df.agg(F.sum("units_inspected").alias("u"), F.sum("defect_count").alias("d"),
                 *[F.sum(p).alias(f"s_{p}") for p in params], *[F.count(p).alias(f"c_{p}") for p in params]).first()
    total_u = F.lit(tot["u"] or 0).cast("bigint")
    total_d = F.lit(tot["d"] or 0).cast("bigint")
    min_units = F.lit(max(SUPPORT_MIN, int((tot["u"] or 0) * SUPPORT_SHARE))).cast("bigint")
    # at most Σu / min_units ≤ 200 values per column can qualify (proven bound), so the
    # keep-lists travel as literals; all other values become NULL before the cube is built
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in CATS]))
    keeps = (df.select(value.alias("x"), "units_inspected").groupBy("x.c", "x.v").agg(F.sum("units_inspected").alias("u"))
               .where((F.col("u") >= min_units) & F.col("v").isNotNull()).collect())

    def kept(c):
        vals = sorted(r["v"] for r in keeps if r["c"] == c)
        return F.when(F.col(c).cast("string").isin(vals), F.col(c).cast("string")) if vals else F.lit(None).cast("string")

    base = df.select(
        *[kept(c).alias(c) for c in CATS], *[F.col(c).cast("string").alias(f"raw_{c}") for c in CATS],
        *[F.coalesce(F.col(p) > thr_cols[p], F.lit(False)).alias(dim_name(p)) for p in params],
        F.to_date(F.date_trunc("week", "timestamp")).alias("week"),
        F.col("defect_type").cast("string").alias("defect_type"),
        "units_inspected", "defect_count", "timestamp", *params)
    fine = base.groupBy(*CATS, *[dim_name(p) for p in params], "week", "defect_type").agg(
        F.sum("units_inspected").alias("u"), F.sum("defect_count").alias("d"), F.count(F.lit(1)).alias("n"),
        F.min("timestamp").alias("ts_min"), F.max("timestamp").alias("ts_max"),
        *[F.sum(p).alias(f"s_{p}") for p in params], *[F.count(p).alias(f"c_{p}") for p in params])
    if checkpoint:
        # stored in spark.checkpoint.dir: the passes below re-read the cube, and a lost
        # executor does not send them back to the inspection scan
        fine = materialize(fine, "cube")
    dims = CATS + [dim_name(p) for p in params]
    labels = {c: c for c in CATS}
    labels.update({dim_name(p): f"{p}_bucket" for p in params})
    return MiningSpace(dims=dims, labels=labels, params=params, thresholds=q, min_units=min_units,
                       param_sums={p: F.lit(tot[f"s_{p}"]).cast("double") for p in params},
                       param_counts={p: F.lit(tot[f"c_{p}"]).cast("bigint") for p in params},
                       total_u=total_u, total_d=total_d, fine=fine, base=base, max_depth=max_depth)


def _sets(space: MiningSpace, max_depth: int) -> list[tuple[str, ...]]:
    return [c for c in space.combos if len(c) <= max_depth]


def _expanded(space: MiningSpace, cube: DataFrame, max_depth: int, carry: list[str],
              passing: DataFrame | None = None, min_depth: int = 1, parents: DataFrame | None = None) -> DataFrame:
    """GROUPING SETS without the 92× blow-up: every cube row is exploded only into the
    combinations it can belong to (a categorical value that survived pruning, a
    parameter flag that is set) — typically ~10, not 92.  Combinations are bit masks
    over the dimensions; a row's valid mask selects them with one ``filter``.  When
    ``passing`` (qualifying slice keys, ≤ 18,400 rows by the support bound) is given,
    rows of other slices are dropped by a broadcast semi-join *before* the shuffle.  With
    ``parents`` (supported slices one level up, as bounded), only rows go on whose slice has both
    its first and its last factor's removal among them."""
    bits = {d: 1 << i for i, d in enumerate(space.dims)}
    masks = [sum(bits[d] for d in c) for c in _sets(space, max_depth) if len(c) >= min_depth]
    valid = sum((F.when(F.col(d).isNotNull() if d in CATS else F.col(d) == F.lit(True), bits[d])
                 .otherwise(0)) for d in space.dims)
    g = cube.select(*carry, *space.dims, F.explode(F.filter(
        F.array(*[F.lit(m) for m in masks]), lambda m: m.bitwiseAND(valid) == m)).alias("_m"))
    if parents is not None:
        top = F.create_map(*[F.lit(x) for m in masks for x in (m, 1 << (m.bit_length() - 1))])
        for removed in (F.col("_m").bitwiseAND(F.col("_m") - 1), F.col("_m") - top[F.col("_m")]):
            rest = F.concat_ws("|", *[F.when(removed.bitwiseAND(bits[d]) != 0, F.col(d).cast("string")).otherwise("*") for d in space.dims])
            g = g.join(F.broadcast(parents.select(F.col("skey").alias("_parent"))), rest == F.col("_parent"), "left_semi")
    act = {d: F.col("_m").bitwiseAND(bits[d]) != 0 for d in space.dims}
    g = g.select(*carry, *[F.when(act[d], F.col(d)).alias(d) for d in space.dims],
                 *[act[d].alias(f"a_{d}") for d in space.dims])
    g = g.withColumn("skey", F.concat_ws("|", *[F.coalesce(F.col(d).cast("string"), F.lit("*"))
                                                for d in space.dims]))
    if passing is not None:
        g = g.join(F.broadcast(passing.select("skey")), "skey", "left_semi")
    return g


def slices(space: MiningSpace, max_depth: int = 3) -> DataFrame:
    """P-1..P-4: every qualifying slice with in/out rates, lift and Yates p-value.

    Up to three factors are counted in one pass.  Deeper levels come one by one: a slice of k factors is
    a candidate only if slices of k - 1 of them have support, as support can only fall with depth."""
    sums = ["u", "d", "n"] + [f"s_{p}" for p in space.params] + [f"c_{p}" for p in space.params]
    cube = space.fine.groupBy(*space.dims).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"))

    def counted(e: DataFrame) -> DataFrame:
        return e.groupBy("skey", *space.dims, *[f"a_{d}" for d in space.dims]).agg(
            *[F.sum(c).alias(c) for c in sums], F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"))

    s = counted(_expanded(space, cube, min(max_depth, 3), sums + ["ts_min", "ts_max"]))
    for level in range(4, min(max_depth, len(space.dims)) + 1):
        held = materialize(s.where(F.col("u") >= space.min_units), "supported-slices")
        depth = sum(F.col(f"a_{d}").cast("int") for d in space.dims)
        e = _expanded(space, cube, level, sums + ["ts_min", "ts_max"], min_depth=level, parents=held.where(depth == level - 1))
        s = held.unionByName(counted(e))
    s = (s.withColumn("tot_u", space.total_u).withColumn("tot_d", space.total_d)
          .withColumn("min_units", space.min_units)
          .withColumn("u_out", F.col("tot_u") - F.col("u")).withColumn("d_out", F.col("tot_d") - F.col("d")))
    for p in space.params:
        s = s.withColumn(f"tot_s_{p}", space.param_sums[p]).withColumn(f"tot_c_{p}", space.param_counts[p])
    s = s.where((F.col("u") >= F.col("min_units")) & (F.col("u_out") >= F.col("min_units")))
    r_in = "CAST(`d` AS DOUBLE) / CAST(greatest(1, `u`) AS DOUBLE)"
    r_out = "CAST(`d_out` AS DOUBLE) / CAST(greatest(1, `u_out`) AS DOUBLE)"
    s = (s.withColumn("r_in", X.spark(r_in)).withColumn("r_out", X.spark(r_out))
          .withColumn("lift_raw", F.when(F.col("r_out") > 0, F.col("r_in") / F.col("r_out")))
          .withColumn("global_rate", X.spark("CAST(`tot_d` AS DOUBLE) / CAST(greatest(1, `tot_u`) AS DOUBLE)")))
    s = X.chi2_pvalue_staged(s, "`d`", "(`u` - `d`)", "`d_out`", "(`u_out` - `d_out`)", "p_raw")
    s = s.where(F.col("p_raw").isNotNull() & F.col("lift_raw").isNotNull() & (F.col("lift_raw") >= 1.0))
    depth = sum(F.col(f"a_{d}").cast("int") for d in space.dims)
    mask = sum(F.col(f"a_{d}").cast("int") * (1 << i) for i, d in enumerate(space.dims))
    order = {sum(1 << space.dims.index(d) for d in c): i for i, c in enumerate(space.combos)}
    combo_idx = F.create_map(*[x for m, i in order.items() for x in (F.lit(m), F.lit(i))])[mask]
    return s.withColumn("factor_count", depth.cast("bigint")).withColumn("combo_idx", combo_idx.cast("bigint"))


def describe(space: MiningSpace) -> list[Column]:
    """P-11: factor keys and description text (Machine M04 + Shift C + Temperature >78.4)."""
    keys, desc = [], []
    for d in space.dims:
        a = F.col(f"a_{d}")
        if d in CATS:
            word = {"machine_id": "Machine", "shift": "Shift", "batch_id": "Batch"}[d]
            keys.append(F.when(a, F.concat(F.lit(f"{d}="), F.col(d))))
            desc.append(F.when(a, F.concat(F.lit(f"{word} "), F.col(d))))
        else:
            p = d[3:]
            txt = X.spark(X.g_text(X.sig6(X.lit(space.thresholds[p]))))
            keys.append(F.when(a, F.concat(F.lit(f"{p}_bucket=>"), txt)))
            desc.append(F.when(a, F.concat(F.lit(f"{p.capitalize()} >"), txt)))
    return [F.concat_ws(";", *keys).alias("factors"), F.concat_ws(" + ", *desc).alias("description")]


def slice_profiles(space: MiningSpace, passing: DataFrame, max_depth: int = 3, checkpoint: bool = True) -> DataFrame:
    """Per-slice breakdowns: (kind, key) for kind ∈ {week, defect type, batch, shift, machine} from the
    cube; batches, shifts and machines that it does not hold (pruned or null) from their rows.  Rows of
    non-qualifying slices are dropped by the broadcast semi-join before the shuffle, and one
    aggregate yields (slice, kind, key) → units, defects, rows: its size is bounded by the
    qualifying slices times the members that they have."""
    def tag(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    def told(*tags):
        return F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull()))

    tags = told(tag("week", F.col("week").cast("string")), tag("type", F.col("defect_type")),
                *[F.when(F.col(c).isNotNull(), tag(c, F.col(c))) for c in CATS])
    raw = told(*[F.when(F.col(c).isNull(), tag(c, F.col(f"raw_{c}"))) for c in CATS])
    pruned = reduce(Column.__or__, [F.col(c).isNull() for c in CATS])
    measures = [F.sum("u").alias("u"), F.sum("d").alias("d"), F.sum("n").alias("n")]
    cube = space.fine.select(*space.dims, "u", "d", "n", tags.alias("t")).unionByName(
        space.base.where(pruned).select(*space.dims, F.col("units_inspected").alias("u"), F.col("defect_count").alias("d"),
                          F.lit(1).cast("bigint").alias("n"), raw.alias("t"))) \
        .groupBy(*space.dims, "t.kind", "t.key").agg(*measures)
    prof = (_expanded(space, cube, max_depth, ["kind", "key", "u", "d", "n"], passing)
            .groupBy("skey", "kind", "key").agg(F.sum("u").alias("u"), F.sum("d").alias("d"), F.sum("n").alias("n")))
    return materialize(prof, "profiles") if checkpoint else prof


def recurrence(space: MiningSpace, prof: DataFrame) -> DataFrame:
    """P-5: per slice, share of weeks (both slice and all data ≥ 50 units) where the slice
    rate beats the all-data rate; 0 without such weeks."""
    wk = prof.where(F.col("kind") == "week").select("skey", F.col("key").alias("week"), "u", "d")
    totals = space.fine.groupBy(F.col("week").cast("string").alias("week")).agg(
        F.sum("u").alias("wu"), F.sum("d").alias("wd"))
    # one row per week of the observed span: sized by time, not data → AQE picks the join
    j = wk.join(totals, "week").where((F.col("wu") >= WEEK_MIN_UNITS) & (F.col("u") >= WEEK_MIN_UNITS))
    win = X.spark("CAST(`d` AS DOUBLE) / CAST(greatest(1, `u`) AS DOUBLE) > "
                  "CAST(`wd` AS DOUBLE) / CAST(greatest(1, `wu`) AS DOUBLE)")
    return j.groupBy("skey").agg(F.count(F.lit(1)).alias("weeks"), F.sum(win.cast("int")).alias("wins")) \
            .select("skey", F.when(F.col("weeks") > 0, F.col("wins") / F.col("weeks")).otherwise(0.0)
                    .alias("recurrence_raw"))


def dominant_types(prof: DataFrame) -> DataFrame:
    """P-8: top-3 defect types by rows in the slice, dominant real type or 'Multiple…'."""
    t = prof.where(F.col("kind") == "type").select("skey", F.col("key").alias("defect_type"), "n")
    w = Window.partitionBy("skey").orderBy(F.col("n").desc(), F.col("defect_type"))
    top = t.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= TOP_TYPES)
    g = top.groupBy("skey").agg(F.sort_array(F.collect_list(F.struct("rk", "defect_type", "n"))).alias("top"))
    nd = "(" + ", ".join(f"'{v}'" for v in MINER_NO_DEFECT) + ")"
    real = f"filter(top, x -> NOT (lower(trim(x.defect_type)) IN {nd}))"
    total = "aggregate(top, CAST(0 AS BIGINT), (a, x) -> a + x.n)"
    dom = (f"CASE WHEN size({real}) > 0 THEN CASE WHEN CAST(element_at({real}, 1).n AS DOUBLE) / "
           f"CAST(greatest(1, {total}) AS DOUBLE) < {X.lit(DOMINANCE_SHARE)} AND size({real}) > 1 "
           f"THEN '{MULTIPLE}' ELSE element_at({real}, 1).defect_type END "
           f"WHEN size(top) > 0 THEN element_at(top, 1).defect_type ELSE '{MULTIPLE}' END")
    return g.select("skey", F.expr(dom).alias("dominant_type"),
                    F.expr("array_join(transform(top, x -> concat(x.defect_type, ':', CAST(x.n AS STRING))), ', ')")
                    .alias("top_defect_types"))


def affected(prof: DataFrame, cat: str, first: int | None = None) -> DataFrame:
    """P-12: sorted distinct raw values of ``cat`` inside each slice (first ``first``).
    The per-slice top-k is a ``row_number() <= k`` filter, which Spark turns into a
    partial (map-side) window group limit: no slice's full member list is gathered."""
    t = prof.where(F.col("kind") == cat).select("skey", F.col("key").alias("v"))
    if first is not None:
        w = Window.partitionBy("skey").orderBy("v")
        t = t.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= first).drop("rk")
    return t.groupBy("skey").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias(f"affected_{cat}"))


def patterns(df: DataFrame, max_depth: int = 3, defect_type: str | None = None,
             checkpoint: bool = True, thresholds: dict[str, float | None] | None = None) -> DataFrame:
    """P-1..P-15: the full pattern table, ranked, with ids for the first 60."""
    space = mining_space(df, max_depth, checkpoint, thresholds)
    s = slices(space, max_depth)
    if checkpoint:
        s = materialize(s, "slices")
    passing = s.select("skey")
    prof = slice_profiles(space, passing, max_depth, checkpoint)
    rec = recurrence(space, prof)
    s = s.join(rec, "skey", "left").withColumn("recurrence_raw", F.coalesce("recurrence_raw", F.lit(0.0)))
    s = s.join(dominant_types(prof), "skey", "left")
    for cat, first in (("batch_id", BATCHES_LISTED), ("shift", None), ("machine_id", None)):
        s = s.join(affected(prof, cat, first), "skey", "left")
    if defect_type is not None:
        s = _restrict_to_type(space, s, defect_type, max_depth)
    else:
        s = (s.withColumn("r_in_dt", F.col("r_in")).withColumn("r_out_dt", F.col("r_out"))
              .withColumn("lift_dt", F.col("lift_raw")))
    s = (s.withColumn("sc_lift", X.spark(X.score_lift("`lift_raw`")))
          .withColumn("sc_significance", X.spark(X.score_significance("`p_raw`")))
          .withColumn("sc_sample_size", X.spark(X.score_sample("`u`")))
          .withColumn("sc_recurrence", F.col("recurrence_raw"))
          .withColumn("sc_effect_size", X.spark(X.score_effect("`r_in`", "`global_rate`"))))
    parts = {k: f"`sc_{k}`" for k in ("lift", "significance", "sample_size", "recurrence", "effect_size")}
    s = (s.withColumn("pattern_score", X.spark(X.composite_score(parts)))
          .withColumn("lift", X.spark(X.round_half_up("`lift_dt`", 2))))
    # rank: score desc, lift desc, then the order slices are enumerated in (combination,
    # then values) — a total order.  One row per qualifying slice (≤ 18,400), so the
    # single-partition sort is bounded.
    w = Window.orderBy(F.col("pattern_score").desc(), F.col("lift").desc(), F.col("combo_idx"),
                       *[F.col(d).asc_nulls_first() for d in CATS])
    s = s.withColumn("rank", F.row_number().over(w).cast("bigint"))
    # presentation after the window: a fresh code-generation stage
    score_part = lambda k: X.spark(f"CAST({X.round_half_up(f'({parts[k]}) * 1e2', 0)} AS BIGINT)")
    out = s.select(
        F.when(F.col("rank") <= TOP_IDS, F.format_string("P-%03d", F.col("rank"))).alias("pattern_id"), "rank",
        "skey", "combo_idx", *[F.col(d) for d in space.dims], *describe(space),
        "factor_count", (F.col("factor_count") >= 2).alias("is_multi_factor"),
        F.col("dominant_type").alias("defect_type"), "top_defect_types",
        X.spark(X.round_half_up("`r_in_dt` * 1e2", 2)).alias("slice_rate"),
        X.spark(X.wilson_lower_pct("`d`", "`u`")).alias("ci_lower"),
        X.spark(X.wilson_upper_pct("`d`", "`u`")).alias("ci_upper"),
        X.spark(X.round_half_up("`r_out_dt` * 1e2", 2)).alias("baseline_rate"),
        "lift",
        X.spark(X.round_half_up("(`r_in_dt` - `r_out_dt`) * 1e2", 2)).alias("effect_size_pp"),
        F.col("u").alias("sample_size"), F.col("n").alias("record_count"),
        F.col("u").alias("units_inspected"), F.col("d").alias("defective_units"),
        X.spark(X.round_half_up("`p_raw`", 4)).alias("p_value"),
        X.spark(X.p_display("`p_raw`")).alias("p_display"),
        X.spark(X.association("`lift_dt`", "`p_raw`")).alias("association"),
        X.spark(X.confidence("`p_raw`")).alias("confidence"),
        X.spark(X.round_half_up("`recurrence_raw`", 2)).alias("recurrence"),
        "pattern_score",
        score_part("lift").alias("score_lift"), score_part("significance").alias("score_significance"),
        score_part("sample_size").alias("score_sample_size"), score_part("recurrence").alias("score_recurrence"),
        score_part("effect_size").alias("score_effect_size"),
        F.to_date("ts_min").alias("date_min"), F.to_date("ts_max").alias("date_max"),
        "affected_batch_id", "affected_shift", "affected_machine_id",
        *[F.col(c) for c in ("lift_raw", "p_raw", "r_in", "r_out", "u_out", "d_out", "recurrence_raw")],
        *_param_stats(space))
    # one row per qualifying slice (≤ 18,400): materialise once so recommendations,
    # evidence and exports do not re-run the mining passes
    return materialize(out, "patterns") if checkpoint else out


def _param_stats(space: MiningSpace) -> list[Column]:
    """P-13: mean of each active parameter in the slice vs its complement (1 dp) + threshold."""
    items = []
    for p in space.params:
        a = F.col(f"a_{dim_name(p)}")
        mean_in = f"CAST(`s_{p}` AS DOUBLE) / CAST(`c_{p}` AS DOUBLE)"
        txt = X.spark(f"concat('{p}: in ', {X.fixed_text(mean_in, 1)}, ', out ', "
                      f"{X.fixed_text(f'(`tot_s_{p}` - `s_{p}`) / CAST(`tot_c_{p}` - `c_{p}` AS DOUBLE)', 1)}, "
                      f"', threshold > ', {X.g_text(X.sig6(X.lit(space.thresholds[p])))})")
        items.append(F.when(a, txt))
    return [F.concat_ws("; ", *items).alias("param_stats")] if items else [F.lit("").alias("param_stats")]


def _restrict_to_type(space: MiningSpace, s: DataFrame, t: str, max_depth: int) -> DataFrame:
    """P-9: rates among one defect type; slice needs ``min_units`` of it; complement falls
    back to the global rate below ``min_units``; lift ≥ 1; dominant = the type."""
    cube = space.fine.where(F.col("defect_type") == t).groupBy(*space.dims).agg(
        F.sum("u").alias("u"), F.sum("d").alias("d"))
    tt = _expanded(space, cube, max_depth, ["u", "d"], s.select("skey")).groupBy("skey").agg(
        F.sum("u").alias("tu"), F.sum("d").alias("td"))
    tot = space.fine.where(F.col("defect_type") == t).agg(F.sum("u").alias("t_u"), F.sum("d").alias("t_d"))
    s = (s.join(tt, "skey", "inner").withColumn("type_tot_u", tot.select("t_u").scalar())
          .withColumn("type_tot_d", tot.select("t_d").scalar()))
    s = s.where(F.col("tu") >= F.col("min_units"))
    s = (s.withColumn("r_in_dt", X.spark("CAST(`td` AS DOUBLE) / CAST(greatest(1, `tu`) AS DOUBLE)"))
          .withColumn("r_out_dt", X.spark("CASE WHEN `type_tot_u` - `tu` >= `min_units` THEN "
                                          "CAST(`type_tot_d` - `td` AS DOUBLE) / "
                                          "CAST(greatest(1, `type_tot_u` - `tu`) AS DOUBLE) ELSE `global_rate` END"))
          .withColumn("lift_dt", F.when(F.col("r_out_dt") > 0, F.col("r_in_dt") / F.col("r_out_dt"))))
    return s.where(F.col("lift_dt").isNotNull() & (F.col("lift_dt") >= 1.0)).withColumn("dominant_type", F.lit(t))
