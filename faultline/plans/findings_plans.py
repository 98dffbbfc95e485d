"""Registered recommendation / evidence / export / summary queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from faultline.functions import formulas as X
from faultline.operators import findings as R
from faultline.operators import investigate as C
from faultline.operators import kpi, trend
from faultline.operators import patterns as P
from faultline.plans import pattern_plans as PP
from faultline.plans import trend_plans  # noqa: F401  (registers the oracles reused below)
from faultline.plans.catalog import register
from faultline.plans.kpi_plans import k14 as k14_query
from faultline.session import materialize
from faultline.sources.fixtures import inspections, with_views

Q = X.to_duckdb


def _fmt_sql(template: str, **vals: str) -> str:
    parts = []
    for piece in re.split(r"(\{[A-Za-z0-9_]+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(vals[piece[1:-1]])
        else:
            parts.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def _pattern_view_sql() -> str:
    """``patv``: the oracle's pattern table with the Spark operator's column names."""
    part = lambda k: Q(f"CAST({X.round_half_up(f'(`sc_{k}`) * 1e2', 0)} AS BIGINT)")
    return f"""patv AS (
  SELECT CASE WHEN rank <= 60 THEN concat('P-', lpad(CAST(rank AS VARCHAR), 3, '0')) END AS pattern_id, rank,
         {PP.DESCRIPTION_SQL}, dominant_type AS defect_type, lift, {Q(X.round_half_up('"p_raw"', 4))} AS p_value,
         {Q(X.p_display('"p_raw"'))} AS p_display, u AS sample_size, d AS defective_units, pattern_score,
         {Q(X.round_half_up('"r_in" * 1e2', 2))} AS slice_rate, {Q(X.round_half_up('"r_out" * 1e2', 2))} AS baseline_rate,
         CAST(ts_min AS DATE) AS date_min, CAST(ts_max AS DATE) AS date_max, affected_batch_id, affected_shift,
         machine_id, shift, batch_id, {", ".join(f"hi_{p}" for p in PP.PARAMS)},
         {Q(X.round_half_up('"recurrence_raw"', 2))} AS recurrence, {Q(X.confidence('"p_raw"'))} AS confidence,
         {Q(X.association('"lift_raw"', '"p_raw"'))} AS association,
         {part('lift')} AS score_lift, {part('significance')} AS score_significance,
         {part('sample_size')} AS score_sample_size, {part('recurrence')} AS score_recurrence,
         {part('effect_size')} AS score_effect_size, factor_count
  FROM pat, thr)"""


def _rules_sql() -> str:
    param = "NULL"
    for p in reversed(PP.PARAMS):
        param = f"CASE WHEN hi_{p} THEN '{p}' ELSE {param} END"
    v = dict(desc="description", dt="defect_type", lift="CAST(lift AS VARCHAR)", n="CAST(sample_size AS VARCHAR)",
             m="machine_id", s="shift", b="batch_id", param="param", PARAM="upper(param)")
    mon = "(lift < 1.5 OR p_value > 0.05)"
    cat = (f"CASE WHEN {mon} THEN '{R.CAT_MONITORING}' "
           f"WHEN machine_id IS NOT NULL AND param IS NOT NULL THEN {_fmt_sql(R.CAT_PARAM, **v)} "
           f"WHEN machine_id IS NOT NULL AND shift IS NOT NULL THEN {_fmt_sql(R.CAT_MACHINE_SHIFT, **v)} "
           f"WHEN machine_id IS NOT NULL THEN {_fmt_sql(R.CAT_MACHINE, **v)} "
           f"WHEN shift IS NOT NULL THEN {_fmt_sql(R.CAT_SHIFT, **v)} "
           f"WHEN batch_id IS NOT NULL THEN {_fmt_sql(R.CAT_BATCH, **v)} ELSE '{R.CAT_GENERAL}' END")
    text = (f"CASE WHEN {mon} THEN {_fmt_sql(R.REC_MONITORING, **v)} "
            f"WHEN machine_id IS NOT NULL AND param IS NOT NULL THEN {_fmt_sql(R.REC_PARAM, **v)} || "
            f"CASE WHEN shift IS NOT NULL THEN {_fmt_sql(R.REC_PARAM_SHIFT, **v)} ELSE '' END || '{R.REC_PARAM_END}' "
            f"WHEN machine_id IS NOT NULL AND shift IS NOT NULL THEN {_fmt_sql(R.REC_MACHINE_SHIFT, **v)} "
            f"WHEN machine_id IS NOT NULL THEN {_fmt_sql(R.REC_MACHINE, **v)} "
            f"WHEN shift IS NOT NULL THEN {_fmt_sql(R.REC_SHIFT, **v)} "
            f"WHEN batch_id IS NOT NULL THEN {_fmt_sql(R.REC_BATCH, **v)} ELSE {_fmt_sql(R.REC_GENERAL, **v)} END")
    prio = ("CASE WHEN pattern_score >= 80 THEN 'Critical' WHEN pattern_score >= 60 THEN 'High' "
            "WHEN pattern_score >= 40 THEN 'Medium' ELSE 'Low' END")
    return f"""rp AS (SELECT patv.*, {param} AS param FROM patv),
rules AS (SELECT rp.*, {cat} AS category, {text} AS rec_text, {prio} AS priority FROM rp),
dedup AS (SELECT * FROM rules WHERE (lift >= 1.05 OR sample_size <= 50 OR p_value < 0.10)
          QUALIFY row_number() OVER (PARTITION BY category ORDER BY rank) = 1),
recs AS (
  SELECT row_number() OVER (ORDER BY CASE priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2
                                     ELSE 3 END, pattern_score DESC, rank) AS rec_rank,
         pattern_id, rank AS pattern_rank, category, priority, lower(priority) AS priority_key,
         pattern_score AS priority_score, rec_text AS text
  FROM dedup),
recs25 AS (SELECT * FROM recs WHERE rec_rank <= 25),
ev AS (
  SELECT pattern_id, pattern_score AS score,
         {_fmt_sql(R.FINDING, desc='description', dt='defect_type')} AS finding,
         CAST(slice_rate AS VARCHAR) || '%' AS ev_slice_rate, CAST(baseline_rate AS VARCHAR) || '%' AS ev_baseline_rate,
         CAST(lift AS VARCHAR) || 'x' AS ev_lift, 'n=' || format('{{:,}}', sample_size) AS ev_sample_size,
         defective_units AS ev_defective_units,
         strftime(date_min, '%Y-%m-%d') || ' to ' || strftime(date_max, '%Y-%m-%d') AS ev_date_range,
         affected_batch_id AS ev_affected_batches, affected_shift AS ev_affected_shifts,
         '{R.STATISTICAL_TEST}' AS ev_statistical_test, p_display AS ev_p_value, confidence AS ev_confidence_label,
         {_fmt_sql(R.INTERPRETATION, lift='CAST(lift AS VARCHAR)', p='p_display')} ||
           CASE WHEN recurrence > 0 THEN {_fmt_sql(R.INTERPRETATION_RECURRENCE, rec='CAST(recurrence AS VARCHAR)')}
           ELSE '' END AS interpretation,
         rec_text AS recommendation, category AS recommendation_category, '{R.DISCLAIMER}' AS disclaimer
  FROM rules WHERE pattern_id IS NOT NULL)"""


def _findings_sql(select: str) -> str:
    return with_views(f"WITH {PP._mining_ctes()},\n{_pattern_view_sql()},\n{_rules_sql()}\n{select.strip()}")


def _all(spark, sf):
    pats = P.patterns(inspections(spark, sf))
    return pats, R.recommendations(pats), R.evidence(pats)


# ---------------------------------------------------------------- R-1..R-5
@register("r05_recommendations", _findings_sql("SELECT * FROM recs25"))
def r05(spark, sf):
    return R.recommendations(P.patterns(inspections(spark, sf)))


# ---------------------------------------------------------------- R-6
@register("r06_pattern_evidence", _findings_sql("SELECT * FROM ev"))
def r06(spark, sf):
    return R.evidence(P.patterns(inspections(spark, sf)))


# ---------------------------------------------------------------- S-5
@register("s05_findings_export", _findings_sql("""
SELECT coalesce(r.pattern_id, '') AS pattern_id, p.description, p.defect_type,
       p.slice_rate AS slice_rate_pct, p.baseline_rate AS baseline_rate_pct, p.lift, p.sample_size, p.defective_units,
       p.p_display AS p_value, p.association, p.confidence, p.pattern_score, p.score_lift, p.score_significance,
       p.score_sample_size, p.score_recurrence, p.score_effect_size, p.recurrence,
       concat_ws(' to ', strftime(p.date_min, '%Y-%m-%d'), strftime(p.date_max, '%Y-%m-%d')) AS date_range,
       replace(coalesce(p.affected_batch_id, ''), ', ', ' ') AS affected_batches,
       coalesce(e.finding, '') AS finding, coalesce(e.interpretation, '') AS interpretation,
       r.text AS recommendation, r.priority
FROM recs25 r LEFT JOIN (SELECT * FROM patv WHERE pattern_id IS NOT NULL) p ON r.pattern_id = p.pattern_id
     LEFT JOIN ev e ON r.pattern_id = e.pattern_id"""))
def s05(spark, sf):
    pats, recs, ev = _all(spark, sf)
    return R.findings_export(pats, recs, ev)


# ---------------------------------------------------------------- R-12
@register("r12_causal_language_audit", _findings_sql("""
SELECT 'recommendations' AS source, count(*) AS rows_checked,
       CAST(sum(CASE WHEN contains(replace(lower(concat_ws(' ', pattern_id, category, priority, priority_key, text)),
            'does not establish that the listed factors caused', ''), 'caused') THEN 1 ELSE 0 END) AS BIGINT) AS caused_mentions
FROM recs25
UNION ALL
SELECT 'evidence', count(*),
       CAST(sum(CASE WHEN contains(replace(lower(concat_ws(' ', pattern_id, finding, ev_slice_rate, ev_baseline_rate, ev_lift,
            ev_sample_size, ev_date_range, ev_affected_batches, ev_affected_shifts, ev_statistical_test, ev_p_value,
            ev_confidence_label, interpretation, recommendation, recommendation_category, disclaimer)),
            'does not establish that the listed factors caused', ''), 'caused') THEN 1 ELSE 0 END) AS BIGINT)
FROM ev"""))
def r12(spark, sf):
    pats, recs, ev = _all(spark, sf)
    return R.causal_language_audit(recommendations=recs, evidence=ev)


@register("r12b_result_invariants", _findings_sql("""
SELECT count(*) AS recommendations, CAST(sum(CASE WHEN contains(lower(text), 'caused') THEN 1 ELSE 0 END) AS BIGINT) AS caused_mentions,
       count(*) <= 25 AS within_limit, CAST(0 AS BIGINT) AS bad_values FROM recs25"""))
def r12b(spark, sf):
    """What must hold of any result: at most 25 recommendations, none that says "caused" in any
    wording, and no NaN or infinity among the patterns' numbers."""
    pats, recs, _ = _all(spark, sf)
    mentions = F.sum(F.lower("text").contains("caused").cast("int")).cast("bigint")
    return recs.agg(F.count(F.lit(1)).alias("recommendations"), mentions.alias("caused_mentions"),
                    (F.count(F.lit(1)) <= 25).alias("within_limit"),
                    F.lit(R.nan_audit(pats).first()[0]).cast("bigint").alias("bad_values"))


# ---------------------------------------------------------------- R-7 / R-9 / R-10 / R-11 / C-9
def _r07_sql() -> str:
    from faultline.plans.investigate_plans import _contribution_sql
    v = dict(f="factor", v="factor_value", dt="'STANDARD'", rin="CAST(defect_rate_in AS VARCHAR)",
             base="CAST(baseline_rate AS VARCHAR)", lift="CAST(lift AS VARCHAR)", p="p_display")
    return f"""SELECT rank, factor, factor_value, {_fmt_sql(R.CONTRIB_FINDING, **v)} AS finding,
       CAST(defect_rate_in AS VARCHAR) || '%' AS ev_slice_rate, CAST(baseline_rate AS VARCHAR) || '%' AS ev_baseline_rate,
       CAST(lift AS VARCHAR) || 'x' AS ev_lift, 'n=' || format('{{:,}}', sample_size) AS ev_sample_size,
       '{R.STATISTICAL_TEST}' AS ev_statistical_test, p_display AS ev_p_value,
       CASE WHEN p_value < 0.01 THEN 'High' WHEN p_value < 0.05 THEN 'Moderate' ELSE 'Low' END AS ev_confidence_label,
       {_fmt_sql(R.CONTRIB_INTERPRETATION, **v)} AS interpretation, '{R.DISCLAIMER}' AS disclaimer
FROM ({_contribution_sql()}) c"""


@register("r07_contribution_evidence", _r07_sql())
def r07(spark, sf):
    return R.contribution_evidence(C.contribution(inspections(spark, sf), "STANDARD"), "STANDARD")


@register("c09_top_evidence_for_type", _findings_sql("""
, dom_t AS (SELECT defect_type FROM patv WHERE pattern_id IS NOT NULL GROUP BY defect_type
            ORDER BY count(*) DESC, defect_type LIMIT 1)
SELECT p.pattern_id, p.pattern_score, p.rank, ev.* EXCLUDE (pattern_id)
FROM patv p JOIN ev ON p.pattern_id = ev.pattern_id, dom_t
WHERE lower(p.defect_type) = lower(dom_t.defect_type)
ORDER BY p.pattern_score DESC, p.rank LIMIT 4"""))
def c09(spark, sf):
    pats, _, ev = _all(spark, sf)
    dominant = pats.where(F.col("pattern_id").isNotNull()).groupBy("defect_type").count() \
        .orderBy(F.col("count").desc(), "defect_type").first()["defect_type"]
    return C.top_evidence_for_type(pats, ev, dominant)


@register("r11_report_sections", _findings_sql("""
, split AS (SELECT *, row_number() OVER (PARTITION BY factor_count >= 2 ORDER BY rank) AS kind_rank FROM patv)
SELECT 'multi_factor_patterns' AS section, kind_rank AS position, pattern_id, description AS item,
       pattern_score AS score FROM split WHERE factor_count >= 2 AND kind_rank <= 10
UNION ALL
SELECT 'single_factor_signals', kind_rank, pattern_id, description, pattern_score FROM split
WHERE factor_count < 2 AND kind_rank <= 8
UNION ALL
SELECT 'recommendations', rec_rank, pattern_id, text, priority_score FROM recs25 WHERE rec_rank <= 10"""))
def r11(spark, sf):
    pats, recs, _ = _all(spark, sf)
    return R.report_sections(pats, recs)


def _r09_sql() -> str:
    from faultline.plans.catalog import ORACLES as O
    fx = lambda c: Q(X.fixed_text(c, 2))
    top = PP._pattern_sql(f"""pattern_score AS t_score, {PP.DESCRIPTION_SQL[:-len(' AS description')]} AS t_desc,
        {Q(X.round_half_up('"r_in" * 1e2', 2))} AS t_in, {Q(X.round_half_up('"r_out" * 1e2', 2))} AS t_base,
        lift AS t_lift""", "WHERE rank = 1")
    return f"""
WITH t AS ({O["k02_kpi_totals"]}),
top AS ({top}),
cp AS (SELECT cp_date AS c_date, before_rate AS c_b, after_rate AS c_a FROM ({O["t07_change_point"]})
       ORDER BY cp_index LIMIT 1),
j AS (SELECT * FROM t LEFT JOIN top ON true LEFT JOIN cp ON true)
SELECT 'Across ' || format('{{:,}}', inspection_records) || ' inspections (' || CAST(date_min AS VARCHAR) || ' to '
       || CAST(date_max AS VARCHAR) || '), the overall defect rate was ' || {fx('"defect_rate_pct"')} || '%.'
       || CASE WHEN t_desc IS NOT NULL THEN ' The strongest detected association (score ' || CAST(t_score AS VARCHAR)
               || '/100) associates ' || t_desc || ' with a ' || {fx('"t_in"')} || '% defect rate versus a '
               || {fx('"t_base"')} || '% baseline (' || {fx('"t_lift"')} || 'x lift).' ELSE '' END
       || CASE WHEN c_date IS NOT NULL THEN ' A rate shift was detected on ' || CAST(c_date AS VARCHAR)
               || ', moving from ' || {fx('"c_b" * 1e2')} || '% to ' || {fx('"c_a" * 1e2')} || '%.' ELSE '' END
       || '{R.FINDINGS_CLOSE}' AS summary
FROM j"""


@register("r09_findings_summary", _r09_sql())
def r09(spark, sf):
    df = inspections(spark, sf)
    pats = P.patterns(df)
    s = trend.trend_series(df)
    return R.findings_summary(kpi.kpi_totals(df), pats, trend.change_points(s))


def _cells(rows: str, number: int, position: str, item: str, texts: tuple = (), numbers: tuple = ()) -> str:
    """The rows of a report section: a list of its fields, unnested."""
    cell = [f"{{'field': '{c}', 'text': CAST(\"{c}\" AS VARCHAR), 'number': CAST(NULL AS DOUBLE)}}" for c in texts]
    cell += [f"{{'field': '{c}', 'text': CAST(NULL AS VARCHAR), 'number': CAST(\"{c}\" AS DOUBLE)}}" for c in numbers]
    return (f"SELECT {number} AS section, '{R.REPORT_TITLES[number - 1]}' AS title, CAST({position} AS BIGINT) AS position, "
            f"CAST({item} AS VARCHAR) AS item, unnest([{', '.join(cell)}], recursive := true) FROM ({rows})")


def _report_sql(source: str) -> str:
    from faultline.plans.catalog import ORACLES as O
    t, m, s = O["k02_kpi_totals"], O["k12_machine_ranking"], O["k13_shift_ranking"]
    cards = ("inspection_records", "units_inspected", "defective_units")
    pats = _findings_sql(", split AS (SELECT *, row_number() OVER (PARTITION BY factor_count >= 2 ORDER BY rank) AS kind_rank FROM patv)"
                         " SELECT * FROM split WHERE {kind}")
    method = " UNION ALL ".join(f"SELECT {i} AS i, '{k}' AS k, '{x}' AS \"text\"" for i, (k, x) in enumerate(R.REPORT_METHOD.items(), 1))
    order = "CASE parameter " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(R.PARAM_ORDER, 1)) + " END"
    found = ("slice_rate", "baseline_rate", "lift")
    return "\nUNION ALL ".join([
        _cells(_r08_sql(), 1, "1", "'summary'", ("executive_summary",)),
        _cells(f"""SELECT *, '{source}' AS source, (SELECT count(*) FROM ({m})) AS machines, (SELECT count(*) FROM ({s})) AS shifts
                   FROM ({t})""", 2, "1", "'dataset'", ("source", "date_min", "date_max"), (*cards, "days_span", "machines", "shifts")),
        _cells(t, 3, "1", "'kpis'", (), (*cards, "defect_rate_pct")),
        _cells(O["t02_adaptive_grain_trend"], 4, "idx + 1", "period", (), ("defect_rate",)),
        _cells(f"SELECT \"text\" AS interpretation FROM ({O['t10_trend_interpretation']})", 4, "0", "'interpretation'", ("interpretation",)),
        _cells(m, 5, "risk_rank", "machine_id", ("status",), ("defect_rate_pct",)),
        _cells(s, 6, "risk_rank", "shift", ("status",), ("defect_rate_pct",)),
        _cells(O["k08_defect_type_ranking"], 7, "rank", "defect_type", (),
               ("defect_count", "defect_rate_pct", "share_of_total_defects_pct")),
        _cells(f"""SELECT m.machine_id, s.shift, c.defect_rate_pct, (m.defect_rate_pct + s.defect_rate_pct) / 2 AS mean_of_margins_pct
                   FROM ({O["k15_machine_shift_heatmap"]}) c JOIN ({m}) m ON c.machine_id = m.machine_id
                     JOIN ({s}) s ON c.shift = s.shift""", 8, "1", "machine_id || ' x ' || shift", (),
               ("defect_rate_pct", "mean_of_margins_pct")),
        _cells(O["k14_parameter_contrast"], 9, order, "parameter", ("status",),
               ("threshold_q90", "high_threshold_rate_pct", "baseline_rate_pct", "lift")),
        _cells(pats.replace("{kind}", "factor_count >= 2 AND kind_rank <= 10"), 10, "kind_rank", "description", ("pattern_id", "defect_type"), (*found, "pattern_score")),
        _cells(pats.replace("{kind}", "factor_count < 2 AND kind_rank <= 8"), 11, "kind_rank", "description", ("defect_type",), (*found, "sample_size")),
        _cells(_findings_sql("SELECT * FROM recs25 WHERE rec_rank <= 10"), 12, "rec_rank", "category", ("priority", "text")),
        _cells(method, 13, "i", "k", ('text',)),
        _cells(f"SELECT '{R.CONTEXT_DISCLAIMER}' AS \"text\"", 14, "1", "'note'", ('text',)),
    ])


def _context_sql() -> str:
    """The record's values from the other oracles, as ``read_context`` lists them."""
    from faultline.plans.catalog import ORACLES as O
    t, m, s, risk = O["k02_kpi_totals"], O["k12_machine_ranking"], O["k13_shift_ranking"], O["k05_highest_risk"]

    def lists(part: str, rows: str, position: str, fields: dict[str, str]) -> str:
        cell = ", ".join(f"{{'field': '{f}', 'value': CAST({c} AS VARCHAR)}}" for f, c in fields.items())
        return (f"SELECT '{part}' AS part, CAST({position} AS INTEGER) AS position, unnest([{cell}], recursive := true) "
                f"FROM ({rows})")

    ranked = {c: c for c in ("defect_rate_pct", "defect_count", "units_inspected")}
    return "\nUNION ALL ".join([
        lists("record", t, "0", {"total_inspections": "inspection_records", "overall_defect_rate_pct": "defect_rate_pct",
                                 "date_min": "date_min", "date_max": "date_max"}),
        lists("record", f"SELECT * FROM ({risk}) WHERE dimension = 'machine_id'", "0", {"highest_risk_machine": "member"}),
        lists("record", f"SELECT * FROM ({risk}) WHERE dimension = 'shift'", "0", {"highest_risk_shift": "member"}),
        lists("record", f"SELECT count(*) AS n FROM ({O['t05_spike_periods']})", "0", {"active_alerts": "n"}),
        lists("record", "SELECT 1", "0", {"disclaimer": f"'{R.CONTEXT_DISCLAIMER}'"}),
        lists("defect_types", f"SELECT *, row_number() OVER (ORDER BY defect_type) AS i FROM ({O['k24_distinct_defect_types']})",
              "i", {"defect_type": "defect_type"}),
        lists("machine_analysis", m, "risk_rank", {"machine_id": "machine_id"} | ranked),
        lists("shift_analysis", s, "risk_rank", {"shift": "shift"} | ranked),
        lists("top_patterns", _findings_sql("SELECT * FROM patv WHERE rank <= 10"), "rank",
              {"pattern_id": "pattern_id", "description": "description", "lift": "lift", "sample_size": "sample_size",
               "score": "pattern_score"}),
        lists("change_points", f"SELECT *, row_number() OVER (ORDER BY cp_date) AS i FROM ({O['t07_change_point']})", "i",
              {"date": "cp_date", "direction": "direction"}),
        lists("recommendations", _findings_sql("SELECT * FROM recs25 WHERE rec_rank <= 8"), "rec_rank",
              {"category": "category", "priority": "priority", "text": '"text"'}),
    ])


def _context(spark, sf):
    df = inspections(spark, sf)
    pats = materialize(P.patterns(df), "patterns")
    s = materialize(trend.trend_series(df), "series")
    return R.context_record(kpi.kpi_totals(df), kpi.highest_risk(df), kpi.distinct_types(df), pats, trend.change_points(s),
                            R.recommendations(pats), kpi.member_ranking(df, "machine_id", "inspection_id"),
                            kpi.member_ranking(df, "shift", "defect_count"), s.where("spike_flag = 1"))


@register("r10_context_record")
def r10(spark, sf):
    return _context(spark, sf)


@register("r10b_context_parsed_back", _context_sql())
def r10b(spark, sf):
    """The JSON document read back, value by value."""
    return R.read_context(materialize(_context(spark, sf), "context"))


def _r08_sql() -> str:
    from faultline.plans.catalog import ORACLES as O
    fx = lambda c: Q(X.fixed_text(c, 2))
    return f"""
WITH t AS ({O["k02_kpi_totals"]}),
m AS (SELECT machine_id AS top_m, defect_rate_pct AS m_rate FROM ({O["k12_machine_ranking"]}) WHERE risk_rank = 1),
s AS (SELECT shift AS top_s, defect_rate_pct AS s_rate FROM ({O["k13_shift_ranking"]}) WHERE risk_rank = 1),
d AS (SELECT defect_type AS dom FROM ({O["k08_defect_type_ranking"]}) WHERE rank = 1),
bp AS (SELECT parameter AS bp, threshold_q90 AS bp_thr, high_threshold_rate_pct AS bp_rate, lift AS bp_lift
       FROM ({O["k14_parameter_contrast"]}) WHERE has_data
       ORDER BY lift DESC, CASE parameter WHEN 'temperature' THEN 0 WHEN 'pressure' THEN 1 WHEN 'speed' THEN 2
                                          WHEN 'vibration' THEN 3 ELSE 4 END LIMIT 1),
j AS (SELECT * FROM t LEFT JOIN m ON true LEFT JOIN s ON true LEFT JOIN d ON true LEFT JOIN bp ON true)
SELECT 'Across ' || format('{{:,}}', inspection_records) || ' inspections from ' || CAST(date_min AS VARCHAR) || ' to '
       || CAST(date_max AS VARCHAR) || ', the overall defect rate was ' || {fx('"defect_rate_pct"')} || '%. '
       || CASE WHEN top_m IS NOT NULL THEN (CASE WHEN starts_with(lower(top_m), 'machine') THEN top_m
                                                 ELSE 'Machine ' || top_m END)
               || ' recorded the highest machine defect rate at ' || {fx('"m_rate"')} || '%'
               ELSE '{R.SUMMARY_MACHINE_NONE}' END
       || ', while '
       || CASE WHEN top_s IS NOT NULL THEN (CASE WHEN starts_with(lower(top_s), 'shift') THEN top_s
                                                 ELSE 'Shift ' || top_s END)
               || ' recorded the highest shift defect rate at ' || {fx('"s_rate"')} || '%'
               ELSE '{R.SUMMARY_SHIFT_NONE}' END
       || '. ' || '{R.SUMMARY_ASSOC}' || ' '
       || upper(substr(coalesce(dom, 'unclassified'), 1, 1)) || lower(substr(coalesce(dom, 'unclassified'), 2))
       || ' was the dominant defect category. '
       || CASE WHEN bp IS NOT NULL THEN 'Elevated ' || bp || ' (>' || CAST({Q(X.round_half_up('"bp_thr"', 2))} AS VARCHAR)
               || ') was associated with a ' || {fx('"bp_rate"')} || '% defect rate (' || {fx('"bp_lift"')}
               || 'x lift).' ELSE '{R.SUMMARY_PARAM_NONE}' END AS executive_summary
FROM j"""


@register("r08_executive_summary", _r08_sql())
def r08(spark, sf):
    df = inspections(spark, sf)
    return R.executive_summary(kpi.kpi_totals(df), kpi.defect_type_ranking(df),
                               kpi.member_ranking(df, "machine_id", "inspection_id"),
                               kpi.member_ranking(df, "shift", "defect_count"), kpi.parameter_contrast(df))


@register("r11b_full_report", _report_sql("parquet:inspections"))
def r11b(spark, sf):
    df = inspections(spark, sf)
    totals, types = materialize(kpi.kpi_totals(df), "totals"), materialize(kpi.defect_type_ranking(df), "types")
    machines = materialize(kpi.member_ranking(df, "machine_id", "inspection_id"), "machines")
    shifts = materialize(kpi.member_ranking(df, "shift", "defect_count"), "shifts")
    params, pats = materialize(kpi.parameter_contrast(df), "parameters"), materialize(P.patterns(df), "patterns")
    series = materialize(trend.trend_series(df), "series")
    return R.full_report(totals, R.executive_summary(totals, types, machines, shifts, params), series,
                         trend.interpretation(series, trend.change_points(series)), machines, shifts, types, kpi.heatmap(df),
                         params, pats, R.recommendations(pats), "parquet:inspections")


# ---------------------------------------------------------------- S-6 / S-7
@register("s06_json_safe_parameter_contrast", __import__("faultline.plans.catalog", fromlist=["ORACLES"])
          .ORACLES["k14_parameter_contrast"])
def s06(spark, sf):
    return R.json_safe(k14_query(spark, sf))


@register("s07_dataset_summary", with_views(f"""
SELECT true AS loaded, count(*) AS rows,
       {Q(X.round_half_up(X.safe_div('sum(defect_count) * 1e2', 'sum(units_inspected)', '0e0'), 2))} AS defect_rate_pct,
       CAST(min("timestamp") AS DATE) AS date_min, CAST(max("timestamp") AS DATE) AS date_max,
       'parquet:inspections' AS source
FROM inspections"""))
def s07(spark, sf):
    return R.dataset_summary(inspections(spark, sf), "parquet:inspections")
