"""Registered pattern-mining queries and their SQL oracles.

The oracle takes a different route from the Spark plan on purpose: DuckDB's own
``GROUPING SETS`` straight over the rows (no cube, no pruning, no bit-mask explode),
with the same formulas.  Agreement therefore checks the cube / pruning / expansion
logic, not just the arithmetic.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from faultline.functions import formulas as X
from faultline.operators import patterns as P
from faultline.plans.catalog import register
from faultline.sources.fixtures import inspections, with_views

Q = X.to_duckdb
PARAMS = ["temperature", "pressure", "speed", "vibration", "humidity"]
DIMS = P.CATS + [f"hi_{p}" for p in PARAMS]


def _combos(depth: int) -> list[tuple[str, ...]]:
    return [c for k in range(1, depth + 1) for c in itertools.combinations(DIMS, k)]


COMBOS = _combos(3)
TYPE_FOR_P09 = "STANDARD"


def _gsets(extra: str = "") -> str:
    return ", ".join("(" + ", ".join(list(c) + ([extra] if extra else [])) + ")" for c in COMBOS)


def _valid_sql() -> str:
    parts = []
    for d in DIMS:
        ok = f"{d} IS NOT NULL" if d in P.CATS else f"{d}"
        parts.append(f"(g_{d} = 1 OR {ok})")
    return " AND ".join(parts)


def _grouping_cols() -> str:
    return ", ".join(f"GROUPING({d}) AS g_{d}" for d in DIMS)


def _skey_sql() -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({d} AS VARCHAR), '*')" for d in DIMS) + ")"


def _combo_idx_sql() -> str:
    bits = {d: 1 << i for i, d in enumerate(DIMS)}
    mask = " + ".join(f"(1 - g_{d}) * {bits[d]}" for d in DIMS)
    cases = " ".join(f"WHEN {sum(bits[d] for d in c)} THEN {i}" for i, c in enumerate(COMBOS))
    return f"CAST(CASE {mask} {cases} END AS BIGINT)"


def _mining_ctes() -> str:
    thr = ", ".join(f"{Q(X.sig6(f'quantile_cont({p}, 0.9)'))} AS t_{p}" for p in PARAMS)
    tot = ", ".join([f"sum({p}) AS tot_s_{p}, count({p}) AS tot_c_{p}" for p in PARAMS])
    flags = ", ".join(f"coalesce({p} > t_{p}, false) AS hi_{p}" for p in PARAMS)
    keeps = ",\n".join(
        f"keep_{c} AS (SELECT CAST({c} AS VARCHAR) AS k FROM inspections GROUP BY 1 "
        f"HAVING sum(units_inspected) >= (SELECT min_units FROM tot))" for c in P.CATS)
    pruned = ", ".join(f"CASE WHEN CAST({c} AS VARCHAR) IN (SELECT k FROM keep_{c}) THEN CAST({c} AS VARCHAR) END AS {c}"
                       for c in P.CATS)
    sums = ", ".join(f"sum({p}) AS s_{p}, count({p}) AS c_{p}" for p in PARAMS)
    r_in = "CAST(d AS DOUBLE) / CAST(greatest(1, u) AS DOUBLE)"
    r_out = "CAST(d_out AS DOUBLE) / CAST(greatest(1, u_out) AS DOUBLE)"
    x, t, p = X.chi2_pvalue_sql_steps('"d"', '("u" - "d")', '"d_out"', '("u_out" - "d_out")')
    return f"""
thr AS (SELECT {thr} FROM inspections),
tot AS (SELECT CAST(sum(units_inspected) AS BIGINT) AS tot_u, CAST(sum(defect_count) AS BIGINT) AS tot_d,
               greatest(50, CAST(floor(sum(units_inspected) * 5e-3) AS BIGINT)) AS min_units, {tot} FROM inspections),
{keeps},
rws AS (SELECT {pruned}, {flags}, CAST(machine_id AS VARCHAR) AS raw_machine_id, CAST(shift AS VARCHAR) AS raw_shift,
               CAST(batch_id AS VARCHAR) AS raw_batch_id, CAST(date_trunc('week', "timestamp") AS DATE) AS week,
               CAST(defect_type AS VARCHAR) AS defect_type, units_inspected, defect_count, "timestamp",
               {", ".join(PARAMS)}
        FROM inspections, thr),
g AS (SELECT {", ".join(DIMS)}, {_grouping_cols()}, CAST(sum(units_inspected) AS BIGINT) AS u,
             CAST(sum(defect_count) AS BIGINT) AS d, count(*) AS n, min("timestamp") AS ts_min,
             max("timestamp") AS ts_max, {sums}
      FROM rws GROUP BY GROUPING SETS ({_gsets()})),
s0 AS (SELECT g.*, {_skey_sql()} AS skey, {_combo_idx_sql()} AS combo_idx, tot.*, tot_u - u AS u_out,
              tot_d - d AS d_out
       FROM g, tot WHERE {_valid_sql()}),
s1 AS (SELECT *, {r_in} AS r_in, {r_out} AS r_out FROM s0 WHERE u >= min_units AND u_out >= min_units),
s2 AS (SELECT *, CASE WHEN r_out > 0 THEN r_in / r_out END AS lift_raw,
              CAST(tot_d AS DOUBLE) / CAST(greatest(1, tot_u) AS DOUBLE) AS global_rate, {Q(x)} AS _chi_x FROM s1),
s3 AS (SELECT *, {Q(t)} AS _chi_t FROM s2),
s4 AS (SELECT *, {Q(p)} AS p_raw FROM s3),
sl AS (SELECT *, CAST({" + ".join(f"(1 - g_{d})" for d in DIMS)} AS BIGINT) AS factor_count FROM s4
       WHERE p_raw IS NOT NULL AND lift_raw IS NOT NULL AND lift_raw >= 1.0),
wk AS (SELECT {", ".join(DIMS)}, week, {_grouping_cols()}, sum(units_inspected) AS u, sum(defect_count) AS d
       FROM rws GROUP BY GROUPING SETS ({_gsets("week")})),
wkt AS (SELECT week, sum(units_inspected) AS wu, sum(defect_count) AS wd FROM rws GROUP BY week),
rec AS (SELECT skey, count(*) AS weeks,
               sum(CASE WHEN CAST(d AS DOUBLE) / CAST(greatest(1, u) AS DOUBLE) >
                             CAST(wd AS DOUBLE) / CAST(greatest(1, wu) AS DOUBLE) THEN 1 ELSE 0 END) AS wins
        FROM (SELECT wk.*, {_skey_sql()} AS skey FROM wk WHERE {_valid_sql()}) w
        JOIN wkt USING (week)
        WHERE wu >= 50 AND u >= 50 AND skey IN (SELECT skey FROM sl)
        GROUP BY skey),
ty AS (SELECT skey, defect_type, n, row_number() OVER (PARTITION BY skey ORDER BY n DESC, defect_type) AS rk
       FROM (SELECT {_skey_sql()} AS skey, defect_type, n
             FROM (SELECT {", ".join(DIMS)}, defect_type, {_grouping_cols()}, count(*) AS n
                   FROM rws GROUP BY GROUPING SETS ({_gsets("defect_type")}))
             WHERE {_valid_sql()})
       WHERE skey IN (SELECT skey FROM sl)),
ty3 AS (SELECT *, NOT (lower(trim(defect_type)) IN ({", ".join(f"'{v}'" for v in P.MINER_NO_DEFECT)})) AS is_real
        FROM ty WHERE rk <= 3),
dom AS (SELECT skey, sum(n) AS total, count(*) FILTER (WHERE is_real) AS n_real,
               arg_min(defect_type, rk) FILTER (WHERE is_real) AS first_real,
               arg_min(n, rk) FILTER (WHERE is_real) AS first_real_n, arg_min(defect_type, rk) AS first_any,
               string_agg(concat(defect_type, ':', CAST(n AS VARCHAR)), ', ' ORDER BY rk) AS top_defect_types
        FROM ty3 GROUP BY skey),
{_affected_sql("batch_id", 8)},
{_affected_sql("shift", None)},
{_affected_sql("machine_id", None)},
full_s AS (
  SELECT sl.*, coalesce(CASE WHEN rec.weeks > 0 THEN CAST(rec.wins AS DOUBLE) / CAST(rec.weeks AS DOUBLE) END, 0.0)
               AS recurrence_raw,
         CASE WHEN n_real > 0 THEN CASE WHEN CAST(first_real_n AS DOUBLE) / CAST(greatest(1, total) AS DOUBLE) < 4.5e-1
                                             AND n_real > 1 THEN '{P.MULTIPLE}' ELSE first_real END
              WHEN first_any IS NOT NULL THEN first_any ELSE '{P.MULTIPLE}' END AS dominant_type,
         dom.top_defect_types, aff_batch_id.affected_batch_id, aff_shift.affected_shift,
         aff_machine_id.affected_machine_id
  FROM sl LEFT JOIN rec USING (skey) LEFT JOIN dom USING (skey) LEFT JOIN aff_batch_id USING (skey)
       LEFT JOIN aff_shift USING (skey) LEFT JOIN aff_machine_id USING (skey)),
sc AS (SELECT *, {Q(X.score_lift('"lift_raw"'))} AS sc_lift, {Q(X.score_significance('"p_raw"'))} AS sc_significance,
              {Q(X.score_sample('"u"'))} AS sc_sample_size, recurrence_raw AS sc_recurrence,
              {Q(X.score_effect('"r_in"', '"global_rate"'))} AS sc_effect_size FROM full_s),
ranked AS (SELECT *, {Q(X.composite_score({k: f'"sc_{k}"' for k in ("lift", "significance", "sample_size", "recurrence", "effect_size")}))} AS pattern_score,
                  {Q(X.round_half_up('"lift_raw"', 2))} AS lift FROM sc),
pat AS (SELECT *, row_number() OVER (ORDER BY pattern_score DESC, lift DESC, combo_idx,
                                     machine_id ASC NULLS FIRST, shift ASC NULLS FIRST, batch_id ASC NULLS FIRST) AS rank
        FROM ranked)"""


def _affected_sql(cat: str, first: int | None) -> str:
    lim = f" WHERE rk <= {first}" if first else ""
    return f"""aff_{cat} AS (
  SELECT skey, string_agg(raw_{cat}, ', ' ORDER BY raw_{cat}) AS affected_{cat}
  FROM (SELECT skey, raw_{cat}, row_number() OVER (PARTITION BY skey ORDER BY raw_{cat}) AS rk
        FROM (SELECT DISTINCT {_skey_sql()} AS skey, raw_{cat}
              FROM (SELECT {", ".join(DIMS)}, raw_{cat}, {_grouping_cols()}
                    FROM rws GROUP BY GROUPING SETS ({_gsets("raw_" + cat)}))
              WHERE {_valid_sql()})
        WHERE skey IN (SELECT skey FROM sl)){lim}
  GROUP BY skey)"""


def _description_sql() -> tuple[str, str]:
    keys, desc = [], []
    words = {"machine_id": "Machine", "shift": "Shift", "batch_id": "Batch"}
    for d in DIMS:
        if d in P.CATS:
            keys.append(f"CASE WHEN g_{d} = 0 THEN concat('{d}=', {d}) END")
            desc.append(f"CASE WHEN g_{d} = 0 THEN concat('{words[d]} ', {d}) END")
        else:
            p = d[3:]
            txt = Q(X.g_text(f'"t_{p}"'))
            keys.append(f"CASE WHEN g_{d} = 0 THEN concat('{p}_bucket=>', {txt}) END")
            desc.append(f"CASE WHEN g_{d} = 0 THEN concat('{p.capitalize()} >', {txt}) END")
    return f"concat_ws(';', {', '.join(keys)}) AS factors", f"concat_ws(' + ', {', '.join(desc)}) AS description"


FACTORS_SQL, DESCRIPTION_SQL = _description_sql()


def _param_stats_sql() -> str:
    items = []
    for p in PARAMS:
        mean_in = f'CAST("s_{p}" AS DOUBLE) / CAST("c_{p}" AS DOUBLE)'
        mean_out = f'("tot_s_{p}" - "s_{p}") / CAST("tot_c_{p}" - "c_{p}" AS DOUBLE)'
        items.append(f"CASE WHEN g_hi_{p} = 0 THEN concat('{p}: in ', {Q(X.fixed_text(mean_in, 1))}, ', out ', "
                     f"{Q(X.fixed_text(mean_out, 1))}, ', threshold > ', {Q(X.g_text(f'\"t_{p}\"'))}) END")
    return f"concat_ws('; ', {', '.join(items)}) AS param_stats"


def _pattern_sql(select: str, where: str = "") -> str:
    return with_views(f"WITH {_mining_ctes()}\nSELECT {select} FROM pat, thr {where}")


def _patterns(spark, sf, **kw):
    return P.patterns(inspections(spark, sf), **kw)


# ---------------------------------------------------------------- P-1..P-4, P-11
@register("p01_qualifying_slices", _pattern_sql(
    f"{FACTORS_SQL}, {DESCRIPTION_SQL}, factor_count, u AS units_inspected, d AS defective_units, n AS record_count"))
def p01(spark, sf):
    return _patterns(spark, sf).select("factors", "description", "factor_count", "units_inspected",
                                       "defective_units", "record_count")


def _deep_sql(depth: int) -> str:
    """The qualifying slices of up to ``depth`` factors by grouping sets, without the tables of a pattern."""
    global COMBOS
    held, COMBOS = COMBOS, _combos(depth)
    try:
        return with_views(f"WITH {_mining_ctes()}\nSELECT {FACTORS_SQL}, factor_count, u AS units_inspected, "
                          "d AS defective_units, n AS record_count, combo_idx FROM sl, thr")
    finally:
        COMBOS = held


@register("p01b_slices_of_four_factors", _deep_sql(4))
def p01b(spark, sf):
    space = P.mining_space(inspections(spark, sf), 4)
    s = P.slices(space, 4)
    return s.select(P.describe(space)[0], "factor_count", F.col("u").alias("units_inspected"), F.col("d").alias("defective_units"),
                    F.col("n").alias("record_count"), "combo_idx")


@register("p03_contrast_and_significance", _pattern_sql(
    f"""{DESCRIPTION_SQL}, {Q(X.round_half_up('"r_in" * 1e2', 2))} AS slice_rate,
    {Q(X.round_half_up('"r_out" * 1e2', 2))} AS baseline_rate, lift,
    {Q(X.round_half_up('("r_in" - "r_out") * 1e2', 2))} AS effect_size_pp, {Q(X.round_half_up('"p_raw"', 4))} AS p_value,
    {Q(X.p_display('"p_raw"'))} AS p_display, {Q(X.association('"lift_raw"', '"p_raw"'))} AS association,
    {Q(X.confidence('"p_raw"'))} AS confidence, u_out, d_out"""))
def p03(spark, sf):
    return _patterns(spark, sf).select("description", "slice_rate", "baseline_rate", "lift", "effect_size_pp",
                                       "p_value", "p_display", "association", "confidence", "u_out", "d_out")


# ---------------------------------------------------------------- P-5
@register("p05_weekly_recurrence", _pattern_sql(
    f"{DESCRIPTION_SQL}, {Q(X.round_half_up('\"recurrence_raw\"', 8))} AS recurrence"))
def p05(spark, sf):
    return _patterns(spark, sf).select("description", X.spark(X.round_half_up("`recurrence_raw`", 8)).alias("recurrence"))


# ---------------------------------------------------------------- P-6 / P-7
def _part(k: str) -> str:
    return Q(f"CAST({X.round_half_up(f'(`sc_{k}`) * 1e2', 0)} AS BIGINT)")


@register("p06_pattern_scores", _pattern_sql(
    f"{DESCRIPTION_SQL}, pattern_score, {_part('lift')} AS score_lift, {_part('significance')} AS score_significance, "
    f"{_part('sample_size')} AS score_sample_size, {_part('recurrence')} AS score_recurrence, "
    f"{_part('effect_size')} AS score_effect_size"))
def p06(spark, sf):
    return _patterns(spark, sf).select("description", "pattern_score", "score_lift", "score_significance",
                                       "score_sample_size", "score_recurrence", "score_effect_size")


# ---------------------------------------------------------------- P-8
@register("p08_dominant_defect_type", _pattern_sql(
    f"{DESCRIPTION_SQL}, dominant_type AS defect_type, top_defect_types"))
def p08(spark, sf):
    return _patterns(spark, sf).select("description", "defect_type", "top_defect_types")


# ---------------------------------------------------------------- P-12 / P-13
@register("p12_slice_envelope", _pattern_sql(
    f"""{DESCRIPTION_SQL}, CAST(ts_min AS DATE) AS date_min, CAST(ts_max AS DATE) AS date_max,
    affected_batch_id, affected_shift, affected_machine_id, n AS record_count,
    {Q(X.wilson_lower_pct('"d"', '"u"'))} AS ci_lower, {Q(X.wilson_upper_pct('"d"', '"u"'))} AS ci_upper"""))
def p12(spark, sf):
    return _patterns(spark, sf).select("description", "date_min", "date_max", "affected_batch_id", "affected_shift",
                                       "affected_machine_id", "record_count", "ci_lower", "ci_upper")


@register("p13_parameter_means", _pattern_sql(f"{DESCRIPTION_SQL}, {_param_stats_sql()}"))
def p13(spark, sf):
    return _patterns(spark, sf).select("description", "param_stats")


# ---------------------------------------------------------------- P-15 / P-16 / P-17
@register("p15_top_patterns", _pattern_sql(
    f"concat('P-', lpad(CAST(rank AS VARCHAR), 3, '0')) AS pattern_id, rank, {DESCRIPTION_SQL}, pattern_score, lift",
    "WHERE rank <= 60"))
def p15(spark, sf):
    return _patterns(spark, sf).where(F.col("pattern_id").isNotNull()).select(
        "pattern_id", "rank", "description", "pattern_score", "lift")


@register("p16_single_and_multi_factor", _pattern_sql(
    f"""CASE WHEN factor_count >= 2 THEN 'multi' ELSE 'single' END AS kind,
    row_number() OVER (PARTITION BY factor_count >= 2 ORDER BY rank) AS kind_rank, rank, {DESCRIPTION_SQL}""",
    "QUALIFY row_number() OVER (PARTITION BY factor_count >= 2 ORDER BY rank) <= 30"))
def p16(spark, sf):
    from faultline.operators.findings import single_multi_split
    return single_multi_split(_patterns(spark, sf)).select("kind", "kind_rank", "rank", "description")


@register("p17_pattern_query", _pattern_sql(
    f"rank, {DESCRIPTION_SQL}, lift, pattern_score",
    "WHERE factor_count >= 2 AND contains(lower(" + DESCRIPTION_SQL[:-len(" AS description")] + "), 'speed')"))
def p17(spark, sf):
    from faultline.operators.findings import pattern_query
    return pattern_query(_patterns(spark, sf), multi=True, text="speed").select(
        "rank", "description", "lift", "pattern_score")


# ---------------------------------------------------------------- P-9
def _p09_sql() -> str:
    t = TYPE_FOR_P09
    return with_views(f"""WITH {_mining_ctes()},
tt AS (SELECT skey, tu, td FROM (
         SELECT {_skey_sql()} AS skey, tu, td, {", ".join(f"g_{d}" for d in DIMS)}, {", ".join(DIMS)}
         FROM (SELECT {", ".join(DIMS)}, {_grouping_cols()}, sum(units_inspected) AS tu, sum(defect_count) AS td
               FROM rws WHERE defect_type = '{t}' GROUP BY GROUPING SETS ({_gsets()})))
       WHERE {_valid_sql()}),
ttot AS (SELECT sum(units_inspected) AS type_tot_u, sum(defect_count) AS type_tot_d FROM rws WHERE defect_type = '{t}'),
r9 AS (SELECT sc.*, tt.tu, tt.td, ttot.* FROM sc JOIN tt USING (skey), ttot WHERE tt.tu >= sc.min_units),
r9b AS (SELECT *, CAST(td AS DOUBLE) / CAST(greatest(1, tu) AS DOUBLE) AS r_in_dt,
               CASE WHEN type_tot_u - tu >= min_units THEN CAST(type_tot_d - td AS DOUBLE) /
                    CAST(greatest(1, type_tot_u - tu) AS DOUBLE) ELSE global_rate END AS r_out_dt FROM r9),
r9c AS (SELECT *, CASE WHEN r_out_dt > 0 THEN r_in_dt / r_out_dt END AS lift_dt FROM r9b)
SELECT {DESCRIPTION_SQL}, '{t}' AS defect_type, {Q(X.round_half_up('"r_in_dt" * 1e2', 2))} AS slice_rate,
       {Q(X.round_half_up('"r_out_dt" * 1e2', 2))} AS baseline_rate, {Q(X.round_half_up('"lift_dt"', 2))} AS lift,
       {Q(X.composite_score({k: f'"sc_{k}"' for k in ("lift", "significance", "sample_size", "recurrence", "effect_size")}))} AS pattern_score
FROM r9c, thr WHERE lift_dt IS NOT NULL AND lift_dt >= 1.0""")


@register("p09_type_restricted_patterns", _p09_sql())
def p09(spark, sf):
    return _patterns(spark, sf, defect_type=TYPE_FOR_P09).select(
        "description", "defect_type", "slice_rate", "baseline_rate", "lift", "pattern_score")
