"""Pattern views, recommendations, evidence and narrative records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions import formulas as X

SPLIT_SIZE = 30


def single_multi_split(patterns: DataFrame, n: int = SPLIT_SIZE) -> DataFrame:
    """P-16: the first ``n`` single-factor and first ``n`` multi-factor patterns in rank order.
    Bounded top-k per group: Spark pushes the ``row_number() <= n`` limit map-side."""
    multi = F.col("factor_count") >= 2
    w = Window.partitionBy(multi).orderBy("rank")
    return (patterns.withColumn("kind", F.when(multi, "multi").otherwise("single"))
                    .withColumn("kind_rank", F.row_number().over(w).cast("bigint"))
                    .where(F.col("kind_rank") <= n))


def pattern_query(patterns: DataFrame, multi: bool | None = None, defect_type: str | None = None,
                  text: str | None = None, sort_by: str = "rank", ascending: bool = True) -> DataFrame:
    """P-17: filter by single / multi, defect type (case-insensitive), description
    substring (case-insensitive); sort by any numeric column."""
    df = patterns
    if multi is not None:
        df = df.where((F.col("factor_count") >= 2) if multi else (F.col("factor_count") < 2))
    if defect_type:
        df = df.where(F.lower(F.col("defect_type")) == defect_type.lower())
    if text:
        df = df.where(F.lower(F.col("description")).contains(text.lower()))
    order = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    return df.orderBy(order, F.col("rank"))


# ---------------------------------------------------------------------------
# Priority tiers, rule categories and the recommendation / evidence
# texts.  Placeholders: {desc} description, {dt} defect type, {lift} lift (2 dp),
# {n} sample size, {m} machine, {s} shift, {b} batch, {param} parameter name.
# ---------------------------------------------------------------------------
PRIORITY_TIERS = ((80, "Critical"), (60, "High"), (40, "Medium"), (0, "Low"))
PRIORITY_ORDER = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
REC_MONITORING = ("Monitor conditions associated with {desc}. Current evidence (lift {lift}x, n={n}) is insufficient "
                  "for immediate action; continue tracking recurrence across future windows.")
REC_PARAM = ("{desc} is strongly associated with elevated {dt} defects (lift {lift}x). Recommended process checks: "
             "verify {param} sensor calibration and control settings on Machine {m}")
REC_PARAM_SHIFT = ", specifically during Shift {s}"
REC_PARAM_END = ". Compare recent operating logs against reference standards."
REC_MACHINE_SHIFT = ("The Machine {m} / Shift {s} combination is associated with elevated {dt} defects (lift {lift}x). "
                     "Cross-check Machine {m} operating logs specifically during Shift {s} for setup deviations or "
                     "handoff anomalies. Review process adherence records for that combination.")
REC_MACHINE = ("Machine {m} is associated with elevated {dt} defects (lift {lift}x). Inspect Machine {m} for mechanical "
               "wear; compare recent calibration logs against reference specifications, and review maintenance "
               "history for the covered period.")
REC_SHIFT = ("Shift {s} is associated with an elevated {dt} defect rate (lift {lift}x). Review process adherence, setup "
             "records, and handoff procedures during Shift {s}, and verify material flow consistency across shifts.")
REC_BATCH = ("Batch {b} is associated with elevated {dt} defects (lift {lift}x). Inspect raw-material and setup records "
             "for Batch {b}; trace supplier lot records and material certificates for the affected window.")
REC_GENERAL = ("The pattern '{desc}' is associated with elevated {dt} defects (lift {lift}x). Investigate the listed "
               "factors jointly and verify operating conditions during the affected window.")
CAT_MONITORING = "MONITORING"
CAT_PARAM = "PROCESS PARAMETER ({PARAM})"
CAT_MACHINE_SHIFT = "MACHINE / SHIFT INTERACTION ({m} / Shift {s})"
CAT_MACHINE = "MACHINE INSPECTION ({m})"
CAT_SHIFT = "SHIFT PROCESS REVIEW (Shift {s})"
CAT_BATCH = "BATCH QUALITY TRACEABILITY (Batch {b})"
CAT_GENERAL = "GENERAL INVESTIGATION"
FINDING = "{desc} is associated with elevated {dt} defects"
INTERPRETATION = ("Strong statistical association detected ({lift}x baseline rate, p={p}). This analysis does not "
                  "establish that the listed factors caused the defects; it identifies conditions co-occurring with "
                  "higher defect rates.")
INTERPRETATION_RECURRENCE = " Recurrence across {rec} of observed windows strengthens the association."
DISCLAIMER = "Association is not causation — this evidence supports investigation, not a causal conclusion."
STATISTICAL_TEST = "Chi-square test of independence"
CONTRIB_FINDING = "{f} {v} is associated with elevated {dt} defects ({rin}% vs {base}% baseline)"
CONTRIB_INTERPRETATION = ("Statistical association of {lift}x the baseline rate for this defect type (p={p}). "
                          "This does not establish causation.")
ELIGIBLE_LIFT = 1.05
ELIGIBLE_MAX_SAMPLE = 50
ELIGIBLE_P = 0.10
MAX_RECOMMENDATIONS = 25
PARAM_ORDER = ("temperature", "pressure", "speed", "vibration", "humidity")


def _fmt(template: str, **cols) -> "F.Column":
    """Render a ``{name}`` template with Column values (concat of literal pieces)."""
    import re
    parts = []
    for piece in re.split(r"(\{[A-Za-z0-9_]+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(cols[piece[1:-1]])
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def priority(score) -> "F.Column":
    """R-1: Critical ≥ 80, High ≥ 60, Medium ≥ 40, else Low."""
    c = None
    for floor, label in PRIORITY_TIERS[:-1]:
        c = F.when(score >= floor, label) if c is None else c.when(score >= floor, label)
    return c.otherwise(PRIORITY_TIERS[-1][1])


def rule_columns(p: DataFrame) -> DataFrame:
    """R-2: category and text per pattern (tests the rounded lift and p-value)."""
    params = [x for x in PARAM_ORDER if f"hi_{x}" in p.columns]
    param = F.lit(None).cast("string")
    for x in reversed(params):
        param = F.when(F.col(f"hi_{x}") == F.lit(True), F.lit(x)).otherwise(param)
    m, s, b = F.col("machine_id"), F.col("shift"), F.col("batch_id")
    has_m, has_s, has_b, has_p = m.isNotNull(), s.isNotNull(), b.isNotNull(), param.isNotNull()
    v = dict(desc=F.col("description"), dt=F.col("defect_type"), lift=F.col("lift").cast("string"),
             n=F.col("sample_size").cast("string"), m=m, s=s, b=b, param=param, PARAM=F.upper(param))
    monitoring = (F.col("lift") < 1.5) | (F.col("p_value") > 0.05)
    category = (F.when(monitoring, CAT_MONITORING)
                 .when(has_m & has_p, _fmt(CAT_PARAM, **v))
                 .when(has_m & has_s, _fmt(CAT_MACHINE_SHIFT, **v))
                 .when(has_m, _fmt(CAT_MACHINE, **v))
                 .when(has_s, _fmt(CAT_SHIFT, **v))
                 .when(has_b, _fmt(CAT_BATCH, **v))
                 .otherwise(CAT_GENERAL))
    text = (F.when(monitoring, _fmt(REC_MONITORING, **v))
             .when(has_m & has_p, F.concat(_fmt(REC_PARAM, **v),
                                           F.when(has_s, _fmt(REC_PARAM_SHIFT, **v)).otherwise(F.lit("")),
                                           F.lit(REC_PARAM_END)))
             .when(has_m & has_s, _fmt(REC_MACHINE_SHIFT, **v))
             .when(has_m, _fmt(REC_MACHINE, **v))
             .when(has_s, _fmt(REC_SHIFT, **v))
             .when(has_b, _fmt(REC_BATCH, **v))
             .otherwise(_fmt(REC_GENERAL, **v)))
    return p.withColumn("category", category).withColumn("rec_text", text) \
            .withColumn("priority", priority(F.col("pattern_score")))


def recommendations(patterns: DataFrame, max_count: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """R-1..R-5: eligible patterns → rule text → first per category (pattern order) →
    priority order, score desc → first ``max_count``.  Works over *all* patterns; ids
    exist for the first 60 only, as in the original."""
    eligible = ((F.col("lift") >= ELIGIBLE_LIFT) | (F.col("sample_size") <= ELIGIBLE_MAX_SAMPLE)
                | (F.col("p_value") < ELIGIBLE_P))
    r = rule_columns(patterns.where(eligible))
    first = Window.partitionBy("category").orderBy("rank")   # bounded: one group per category
    r = r.withColumn("_k", F.row_number().over(first)).where(F.col("_k") == 1)
    order = F.create_map(*[x for k, v in PRIORITY_ORDER.items() for x in (F.lit(k), F.lit(v))])[F.col("priority")]
    w = Window.orderBy(order, F.col("pattern_score").desc(), F.col("rank"))   # ≤ #categories rows
    r = r.withColumn("rec_rank", F.row_number().over(w).cast("bigint")).where(F.col("rec_rank") <= max_count)
    return r.select("rec_rank", "pattern_id", F.col("rank").alias("pattern_rank"), "category", "priority",
                    F.lower(F.col("priority")).alias("priority_key"),
                    F.col("pattern_score").alias("priority_score"), F.col("rec_text").alias("text"))


def evidence(patterns: DataFrame) -> DataFrame:
    """R-6: finding / evidence / interpretation / recommendation / disclaimer per pattern
    with an id (the first 60)."""
    p = rule_columns(patterns.where(F.col("pattern_id").isNotNull()))
    v = dict(desc=F.col("description"), dt=F.col("defect_type"), lift=F.col("lift").cast("string"),
             p=F.col("p_display"), rec=F.col("recurrence").cast("string"))
    interp = F.concat(_fmt(INTERPRETATION, **v),
                      F.when(F.col("recurrence") > 0, _fmt(INTERPRETATION_RECURRENCE, **v)).otherwise(F.lit("")))
    return p.select(
        "pattern_id", F.col("pattern_score").alias("score"), _fmt(FINDING, **v).alias("finding"),
        F.concat(F.col("slice_rate").cast("string"), F.lit("%")).alias("ev_slice_rate"),
        F.concat(F.col("baseline_rate").cast("string"), F.lit("%")).alias("ev_baseline_rate"),
        F.concat(F.col("lift").cast("string"), F.lit("x")).alias("ev_lift"),
        F.concat(F.lit("n="), F.format_number("sample_size", 0)).alias("ev_sample_size"),
        F.col("defective_units").alias("ev_defective_units"),
        F.concat(F.date_format("date_min", "yyyy-MM-dd"), F.lit(" to "), F.date_format("date_max", "yyyy-MM-dd"))
        .alias("ev_date_range"),
        F.col("affected_batch_id").alias("ev_affected_batches"), F.col("affected_shift").alias("ev_affected_shifts"),
        F.lit(STATISTICAL_TEST).alias("ev_statistical_test"), F.col("p_display").alias("ev_p_value"),
        F.col("confidence").alias("ev_confidence_label"),
        interp.alias("interpretation"), F.col("rec_text").alias("recommendation"),
        F.col("category").alias("recommendation_category"), F.lit(DISCLAIMER).alias("disclaimer"))


def contribution_evidence(contrib: DataFrame, defect_type: str) -> DataFrame:
    """R-7: the same four-part evidence for contribution rows."""
    v = dict(f=F.col("factor"), v=F.col("factor_value"), dt=F.lit(defect_type),
             rin=F.col("defect_rate_in").cast("string"), base=F.col("baseline_rate").cast("string"),
             lift=F.col("lift").cast("string"), p=F.col("p_display"))
    conf = F.when(F.col("p_value") < 0.01, "High").when(F.col("p_value") < 0.05, "Moderate").otherwise("Low")
    return contrib.select(
        "rank", "factor", "factor_value", _fmt(CONTRIB_FINDING, **v).alias("finding"),
        F.concat(F.col("defect_rate_in").cast("string"), F.lit("%")).alias("ev_slice_rate"),
        F.concat(F.col("baseline_rate").cast("string"), F.lit("%")).alias("ev_baseline_rate"),
        F.concat(F.col("lift").cast("string"), F.lit("x")).alias("ev_lift"),
        F.concat(F.lit("n="), F.format_number("sample_size", 0)).alias("ev_sample_size"),
        F.lit(STATISTICAL_TEST).alias("ev_statistical_test"), F.col("p_display").alias("ev_p_value"),
        conf.alias("ev_confidence_label"), _fmt(CONTRIB_INTERPRETATION, **v).alias("interpretation"),
        F.lit(DISCLAIMER).alias("disclaimer"))


def findings_export(patterns: DataFrame, recs: DataFrame, ev: DataFrame) -> DataFrame:
    """S-5: one row per recommendation ⟕ its pattern ⟕ its evidence (24 columns)."""
    p = patterns.select("pattern_id", "description", "defect_type", "slice_rate", "baseline_rate", "lift",
                        "sample_size", "defective_units", "p_display", "association", "confidence",
                        "pattern_score", "score_lift", "score_significance", "score_sample_size",
                        "score_recurrence", "score_effect_size", "recurrence", "date_min", "date_max",
                        "affected_batch_id").where(F.col("pattern_id").isNotNull())
    e = ev.select("pattern_id", "finding", "interpretation")
    j = recs.select("rec_rank", "pattern_id", "text", "priority").join(p, "pattern_id", "left").join(e, "pattern_id", "left")
    return j.select(
        F.coalesce("pattern_id", F.lit("")).alias("pattern_id"), "description", "defect_type",
        F.col("slice_rate").alias("slice_rate_pct"), F.col("baseline_rate").alias("baseline_rate_pct"), "lift",
        "sample_size", "defective_units", F.col("p_display").alias("p_value"), "association", "confidence",
        "pattern_score", "score_lift", "score_significance", "score_sample_size", "score_recurrence",
        "score_effect_size", "recurrence",
        F.concat_ws(" to ", F.date_format("date_min", "yyyy-MM-dd"), F.date_format("date_max", "yyyy-MM-dd"))
        .alias("date_range"),
        F.regexp_replace(F.coalesce("affected_batch_id", F.lit("")), ", ", " ").alias("affected_batches"),
        F.coalesce("finding", F.lit("")).alias("finding"), F.coalesce("interpretation", F.lit("")).alias("interpretation"),
        F.col("text").alias("recommendation"), "priority")


def causal_language_audit(**texts: DataFrame) -> DataFrame:
    """R-12: rows whose text mentions "caused" (outside the disclaimer wording), per source."""
    parts = []
    for name, (df) in texts.items():
        cols = [c for c, t in df.dtypes if t == "string"]
        body = F.concat_ws(" ", *[F.col(c) for c in cols])
        # the interpretation's own negated wording ("does not establish that ... caused") is allowed
        cleaned = F.regexp_replace(F.lower(body), "does not establish that the listed factors caused", "")
        parts.append(df.select(F.lit(name).alias("source"), F.lower(cleaned).contains("caused").cast("int").alias("hit")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("rows_checked"), F.sum("hit").alias("caused_mentions"))


def nan_audit(df: DataFrame) -> DataFrame:
    """S-6 check: count of NaN / ±Inf values across the float columns of ``df``."""
    cols = [c for c, t in df.dtypes if t in ("double", "float")]
    if not cols:
        return df.sparkSession.createDataFrame([(0,)], "bad_values long")
    bad = sum((F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf"))).cast("int") for c in cols)
    return df.agg(F.coalesce(F.sum(bad), F.lit(0)).cast("bigint").alias("bad_values"))


def _json_safe(c, kind):
    """Column expression with NaN and ±Inf replaced by null, inside structs, arrays and maps too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_json_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _json_safe(v, kind.valueType))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """S-6: NaN and ±Inf → null at any depth (before ``write.json`` / ``to_json``)."""
    return df.select(*[_json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a result table as CSV (header, quoted) or as JSON lines without NaN."""
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        json_safe(df).write.mode("overwrite").json(path)


# Narrative sentences.
SUMMARY_OPEN = "Across {n} inspections from {d0} to {d1}, the overall defect rate was {rate}%. "
SUMMARY_MACHINE = "{m} recorded the highest machine defect rate at {rate}%"
SUMMARY_SHIFT = "{s} recorded the highest shift defect rate at {rate}%"
SUMMARY_MACHINE_NONE = "Machine defect rates were balanced"
SUMMARY_SHIFT_NONE = "Shift defect rates were balanced"
SUMMARY_ASSOC = "Advanced pattern mining will process multi-factor associations in the background."
SUMMARY_DOMINANT = " {dom} was the dominant defect category. "
SUMMARY_PARAM = ("Elevated {p} (>{thr}) was associated with a {rate}% defect rate ({lift}x lift).")
SUMMARY_PARAM_NONE = "Process parameter sensor data was unpopulated in the dataset."
FINDINGS_OPEN = "Across {n} inspections ({d0} to {d1}), the overall defect rate was {rate}%."
FINDINGS_TOP = (" The strongest detected association (score {score}/100) associates {desc} with a {rin}% defect rate "
                "versus a {base}% baseline ({lift}x lift).")
FINDINGS_CP = " A rate shift was detected on {date}, moving from {before}% to {after}%."
FINDINGS_CLOSE = " All findings are statistical associations; no causal claims are made."
CONTEXT_DISCLAIMER = "All findings are statistical associations, not causal conclusions."


def _one(df: DataFrame) -> DataFrame:
    """Key a one-row frame for an equi-join with other one-row frames."""
    return df.withColumn("_one", F.lit(1))


def _fixed(c: str, digits: int = 2):
    return X.spark(X.fixed_text(c, digits))


def executive_summary(totals: DataFrame, types: DataFrame, machines: DataFrame, shifts: DataFrame,
                      params: DataFrame) -> DataFrame:
    """R-8: one paragraph from KPI totals, dominant type, riskiest machine / shift and the
    parameter with the largest lift.  All inputs are small (one row per member)."""
    m = machines.where(F.col("risk_rank") == 1).select(F.col("machine_id").alias("top_m"),
                                                       F.col("defect_rate_pct").alias("m_rate"))
    s = shifts.where(F.col("risk_rank") == 1).select(F.col("shift").alias("top_s"), F.col("defect_rate_pct").alias("s_rate"))
    dom = types.where(F.col("rank") == 1).select(F.col("defect_type").alias("dom"))
    order = F.create_map(*[x for i, p in enumerate(PARAM_ORDER) for x in (F.lit(p), F.lit(i))])[F.col("parameter")]
    bp = (params.where(F.col("has_data"))
                .withColumn("_r", F.row_number().over(Window.orderBy(F.col("lift").desc(), order)))
                .where("_r = 1")
                .select(F.col("parameter").alias("bp"), F.col("threshold_q90").alias("bp_thr"),
                        F.col("high_threshold_rate_pct").alias("bp_rate"), F.col("lift").alias("bp_lift")))
    j = _one(totals)
    for other in (m, s, dom, bp):
        j = j.join(_one(other), "_one", "left")
    m_label = F.when(F.lower(F.col("top_m")).startswith("machine"), F.col("top_m")) \
        .otherwise(F.concat(F.lit("Machine "), F.col("top_m")))
    s_label = F.when(F.lower(F.col("top_s")).startswith("shift"), F.col("top_s")) \
        .otherwise(F.concat(F.lit("Shift "), F.col("top_s")))
    hrm = F.when(F.col("top_m").isNotNull(), _fmt(SUMMARY_MACHINE, m=m_label, rate=_fixed("`m_rate`"))) \
        .otherwise(F.lit(SUMMARY_MACHINE_NONE))
    hrs = F.when(F.col("top_s").isNotNull(), _fmt(SUMMARY_SHIFT, s=s_label, rate=_fixed("`s_rate`"))) \
        .otherwise(F.lit(SUMMARY_SHIFT_NONE))
    dom_txt = F.coalesce(F.col("dom"), F.lit("unclassified"))
    dom_cap = F.concat(F.upper(F.substring(dom_txt, 1, 1)), F.lower(F.substring(dom_txt, 2, 1 << 20)))
    par = F.when(F.col("bp").isNotNull(), _fmt(
        SUMMARY_PARAM, p=F.col("bp"), thr=X.spark(X.round_half_up("`bp_thr`", 2)).cast("string"),
        rate=_fixed("`bp_rate`"), lift=_fixed("`bp_lift`"))).otherwise(F.lit(SUMMARY_PARAM_NONE))
    text = F.concat(
        _fmt(SUMMARY_OPEN, n=F.format_number("inspection_records", 0), d0=F.col("date_min").cast("string"),
             d1=F.col("date_max").cast("string"), rate=_fixed("`defect_rate_pct`")),
        hrm, F.lit(", while "), hrs, F.lit(". "), F.lit(SUMMARY_ASSOC), _fmt(SUMMARY_DOMINANT, dom=dom_cap), par)
    return j.select(text.alias("executive_summary"))


def findings_summary(totals: DataFrame, patterns: DataFrame, cps: DataFrame) -> DataFrame:
    """R-9: KPI sentence + strongest pattern + first change point + disclaimer."""
    top = patterns.where(F.col("rank") == 1).select(
        F.col("pattern_score").alias("t_score"), F.col("description").alias("t_desc"),
        F.col("slice_rate").alias("t_in"), F.col("baseline_rate").alias("t_base"), F.col("lift").alias("t_lift"))
    cp = cps.orderBy("cp_index").limit(1).select(F.col("cp_date").alias("c_date"), F.col("before_rate").alias("c_b"),
                                                 F.col("after_rate").alias("c_a"))
    j = _one(totals).join(_one(top), "_one", "left").join(_one(cp), "_one", "left")
    text = F.concat(
        _fmt(FINDINGS_OPEN, n=F.format_number("inspection_records", 0), d0=F.col("date_min").cast("string"),
             d1=F.col("date_max").cast("string"), rate=_fixed("`defect_rate_pct`")),
        F.when(F.col("t_desc").isNotNull(), _fmt(
            FINDINGS_TOP, score=F.col("t_score").cast("string"), desc=F.col("t_desc"), rin=_fixed("`t_in`"),
            base=_fixed("`t_base`"), lift=_fixed("`t_lift`"))).otherwise(F.lit("")),
        F.when(F.col("c_date").isNotNull(), _fmt(
            FINDINGS_CP, date=F.col("c_date").cast("string"), before=_fixed("`c_b` * 1e2"),
            after=_fixed("`c_a` * 1e2"))).otherwise(F.lit("")),
        F.lit(FINDINGS_CLOSE))
    return j.select(text.alias("summary"))


def _ranked_list(df: DataFrame, key: str, name: str, limit: int | None = None) -> DataFrame:
    """One row: the members of a K-12 / K-13 ranking as an ordered list of structs."""
    rows = df if limit is None else df.where(F.col("risk_rank") <= limit)
    return rows.agg(F.array_sort(F.collect_list(F.struct(
        "risk_rank", key, "defect_rate_pct", "ci_lower", "ci_upper", "defect_count", "units_inspected", "inspection_count",
        "display_summary"))).alias(name))


def context_record(totals: DataFrame, risk: DataFrame, types: DataFrame, patterns: DataFrame,
                   cps: DataFrame, recs: DataFrame, machines: DataFrame, shifts: DataFrame,
                   alerts: DataFrame | None = None, n_patterns: int = 10, n_recs: int = 8) -> DataFrame:
    """R-10: one JSON document: dataset, defect types, KPI summary, machine and shift analysis
    (their whole rankings), top patterns, change points, top recommendations.

    ``active_alerts`` counts the rows of ``alerts`` (spike periods, for instance); 0 without them.
    Every list is a top-n or has one entry a type, machine, shift or change point.  Without rows
    the lists are empty and the rates 0 or missing."""
    kp = risk.groupBy().agg(
        F.max(F.when(F.col("dimension") == "machine_id", F.col("member"))).alias("highest_risk_machine"),
        F.max(F.when(F.col("dimension") == "machine_id", F.col("rate_pct"))).alias("highest_risk_machine_rate_pct"),
        F.max(F.when(F.col("dimension") == "shift", F.col("member"))).alias("highest_risk_shift"))
    tl = types.agg(F.array_sort(F.collect_list("defect_type")).alias("defect_types"))
    tp = patterns.where(F.col("rank") <= n_patterns).agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank"), "pattern_id", "description", "defect_type", F.col("slice_rate").alias("slice_rate_pct"),
        F.col("baseline_rate").alias("baseline_rate_pct"), "lift", "sample_size",
        F.col("p_display").alias("p_value"), F.col("pattern_score").alias("score")))).alias("top_patterns"))
    cp = cps.agg(F.array_sort(F.collect_list(F.struct(F.col("cp_date").cast("string").alias("date"), "direction",
                                                      "before_rate", "after_rate", "cusum_value"))).alias("change_points"))
    rc = recs.where(F.col("rec_rank") <= n_recs).agg(F.array_sort(F.collect_list(F.struct(
        "rec_rank", "pattern_id", "category", "priority", "text"))).alias("recommendations"))
    al = totals.select(F.lit(0).cast("bigint").alias("active_alerts")) if alerts is None else alerts.agg(
        F.count(F.lit(1)).alias("active_alerts"))
    j = _one(totals)
    for other in (kp, tl, tp, cp, rc, al, _ranked_list(machines, "machine_id", "machine_analysis"),
                  _ranked_list(shifts, "shift", "shift_analysis")):
        j = j.join(_one(other), "_one", "left")
    doc = F.struct(
        F.struct(F.col("inspection_records").alias("total_inspections"),
                 F.col("defect_rate_pct").alias("overall_defect_rate_pct"),
                 F.array(F.col("date_min").cast("string"), F.col("date_max").cast("string")).alias("date_range"))
        .alias("dataset"),
        "defect_types",
        F.struct("highest_risk_machine", "highest_risk_machine_rate_pct", "highest_risk_shift",
                 "active_alerts").alias("kpi_summary"),
        "machine_analysis", "shift_analysis",
        "top_patterns", "change_points", "recommendations", F.lit(CONTEXT_DISCLAIMER).alias("disclaimer"))
    return j.select(F.to_json(doc).alias("context_json"))


#: What a reader needs of a context record, by JSON path: one row of the parsed record each.
CONTEXT_PATHS = {
    "total_inspections": "$.dataset.total_inspections", "overall_defect_rate_pct": "$.dataset.overall_defect_rate_pct",
    "date_min": "$.dataset.date_range[0]", "date_max": "$.dataset.date_range[1]",
    "highest_risk_machine": "$.kpi_summary.highest_risk_machine", "highest_risk_shift": "$.kpi_summary.highest_risk_shift",
    "active_alerts": "$.kpi_summary.active_alerts", "disclaimer": "$.disclaimer"}
#: Lists of a context record: their JSON type, and the fields that are listed.
CONTEXT_LISTS = {
    "machine_analysis": ("array<struct<machine_id:string,defect_rate_pct:double,defect_count:bigint,units_inspected:bigint>>",
                         ("machine_id", "defect_rate_pct", "defect_count", "units_inspected")),
    "shift_analysis": ("array<struct<shift:string,defect_rate_pct:double,defect_count:bigint,units_inspected:bigint>>",
                       ("shift", "defect_rate_pct", "defect_count", "units_inspected")),
    "top_patterns": ("array<struct<pattern_id:string,description:string,lift:double,sample_size:bigint,score:bigint>>",
                     ("pattern_id", "description", "lift", "sample_size", "score")),
    "change_points": ("array<struct<date:string,direction:string>>", ("date", "direction")),
    "recommendations": ("array<struct<category:string,priority:string,text:string>>", ("category", "priority", "text"))}


def read_context(record: DataFrame) -> DataFrame:
    """The record parsed back: ``part``, ``position`` (0 for single values, from 1 in lists), ``field``, ``value`` as text."""
    whole = F.from_json("context_json", ", ".join(f"{k} {t}" for k, (t, _) in CONTEXT_LISTS.items()) + ", defect_types array<string>")
    parsed = record.select("context_json", whole.alias("w"))
    single = [F.struct(F.lit("record").alias("part"), F.lit(0).alias("position"), F.lit(k).alias("field"),
                       F.get_json_object("context_json", p).alias("value")) for k, p in CONTEXT_PATHS.items()]

    def listed(part: str, field: str, of):
        return F.transform(F.col(f"w.{part}"), lambda x, i: F.struct(
            F.lit(part).alias("part"), (i + 1).alias("position"), F.lit(field).alias("field"), of(x).alias("value")))

    lists = [listed("defect_types", "defect_type", lambda x: x)]
    for k, (_, fields) in CONTEXT_LISTS.items():
        lists += [listed(k, f, lambda x, f=f: x[f].cast("string")) for f in fields]
    return parsed.select(F.explode(F.concat(F.array(*single), *lists)).alias("r")).select("r.*")


def report_sections(patterns: DataFrame, recs: DataFrame, n_multi: int = 10, n_single: int = 8,
                    n_recs: int = 10) -> DataFrame:
    """R-11: rows of the report's tables: top multi-factor patterns, single-factor
    signals, recommendations (the drawing itself is not built)."""
    split = single_multi_split(patterns, max(n_multi, n_single))
    multi = split.where((F.col("kind") == "multi") & (F.col("kind_rank") <= n_multi)).select(
        F.lit("multi_factor_patterns").alias("section"), F.col("kind_rank").alias("position"),
        "pattern_id", F.col("description").alias("item"), F.col("pattern_score").alias("score"))
    single = split.where((F.col("kind") == "single") & (F.col("kind_rank") <= n_single)).select(
        F.lit("single_factor_signals").alias("section"), F.col("kind_rank").alias("position"),
        "pattern_id", F.col("description").alias("item"), F.col("pattern_score").alias("score"))
    rs = recs.where(F.col("rec_rank") <= n_recs).select(
        F.lit("recommendations").alias("section"), F.col("rec_rank").alias("position"), "pattern_id",
        F.col("text").alias("item"), F.col("priority_score").alias("score"))
    return multi.unionByName(single).unionByName(rs)


# What the report says about its methods (section 13), in the order of its rows.
REPORT_METHOD = {
    "pattern_score": "Weighted sum of five parts, each from 0 to 1: lift, significance (chi-square), sample size, weekly recurrence, effect size.",
    "baseline": "The defect rate of all units outside the slice.",
    "lift": "Slice rate / baseline rate; above 1 the slice has the higher risk."}
REPORT_TITLES = ("executive_summary", "dataset_overview", "quality_kpis", "trend", "machines", "shifts", "defect_types",
                 "machine_shift_matrix", "process_parameters", "multi_factor_patterns", "single_factor_signals",
                 "recommended_investigations", "methodology", "disclaimer")


def _section(df: DataFrame, number: int, position, item, texts: tuple = (), numbers: tuple = ()) -> DataFrame:
    """Rows of one section: a row per (row of ``df``, field), as ``text`` or as ``number``."""
    cell = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text"), F.lit(None).cast("double").alias("number")) for c in texts]
    cell += [F.struct(F.lit(c).alias("field"), F.lit(None).cast("string").alias("text"), F.col(c).cast("double").alias("number")) for c in numbers]
    return df.select(F.lit(number).alias("section"), F.lit(REPORT_TITLES[number - 1]).alias("title"),
                     position.cast("bigint").alias("position"), item.cast("string").alias("item"),
                     F.explode(F.array(*cell)).alias("c")).select("section", "title", "position", "item", "c.*")


def full_report(totals: DataFrame, summary: DataFrame, series: DataFrame, trend_text: DataFrame, machines: DataFrame,
                shifts: DataFrame, types: DataFrame, cells: DataFrame, params: DataFrame, patterns: DataFrame,
                recs: DataFrame, source: str, n_multi: int = 10, n_single: int = 8, n_recs: int = 10) -> DataFrame:
    """R-11: all 14 sections as one long table: section, title, position, item, field, text, number.

    Inputs are results of the other operators, with a row per period, member, cell, parameter or
    pattern, none per inspection.  A cell of the machine x shift matrix (pairs that occur) has its
    observed rate and, as ``mean_of_margins_pct``, the mean of its machine's and its shift's rate.
    A section whose input is empty has no rows."""
    one = F.lit(1)
    cards = ("inspection_records", "units_inspected", "defective_units")
    size = _one(totals)
    for df, name in ((machines, "machines"), (shifts, "shifts")):
        size = size.join(_one(df.agg(F.count(one).alias(name))), "_one")
    matrix = cells.join(machines.select("machine_id", F.col("defect_rate_pct").alias("m")), "machine_id").join(
        shifts.select("shift", F.col("defect_rate_pct").alias("s")), "shift").withColumn(
        "mean_of_margins_pct", (F.col("m") + F.col("s")) / 2)
    order = F.create_map(*[x for i, p in enumerate(PARAM_ORDER) for x in (F.lit(p), F.lit(i + 1))])[F.col("parameter")]
    split = single_multi_split(patterns, max(n_multi, n_single)).where(
        F.col("kind_rank") <= F.when(F.col("kind") == "multi", n_multi).otherwise(n_single))
    found = ("slice_rate", "baseline_rate", "lift")
    spark = totals.sparkSession
    method = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(t).alias("text"))
                                                       for i, (k, t) in enumerate(REPORT_METHOD.items(), 1)])).alias("r")).select("r.*")
    closing = spark.range(1).select(F.lit(CONTEXT_DISCLAIMER).alias("text"))
    parts = [
        _section(summary, 1, one, F.lit("summary"), ("executive_summary",)),
        _section(size.withColumn("source", F.lit(source)), 2, one, F.lit("dataset"), ("source", "date_min", "date_max"),
                 (*cards, "days_span", "machines", "shifts")),
        _section(totals, 3, one, F.lit("kpis"), (), (*cards, "defect_rate_pct")),
        _section(series, 4, F.col("idx") + 1, F.col("period"), (), ("defect_rate",)),
        _section(trend_text.withColumnRenamed("text", "interpretation"), 4, F.lit(0), F.lit("interpretation"), ("interpretation",)),
        _section(machines, 5, F.col("risk_rank"), F.col("machine_id"), ("status",), ("defect_rate_pct",)),
        _section(shifts, 6, F.col("risk_rank"), F.col("shift"), ("status",), ("defect_rate_pct",)),
        _section(types, 7, F.col("rank"), F.col("defect_type"), (),
                 ("defect_count", "defect_rate_pct", "share_of_total_defects_pct")),
        _section(matrix, 8, one, F.concat_ws(" x ", "machine_id", "shift"), (), ("defect_rate_pct", "mean_of_margins_pct")),
        _section(params, 9, order, F.col("parameter"), ("status",),
                 ("threshold_q90", "high_threshold_rate_pct", "baseline_rate_pct", "lift")),
        _section(split.where("kind = 'multi'"), 10, F.col("kind_rank"), F.col("description"), ("pattern_id", "defect_type"),
                 (*found, "pattern_score")),
        _section(split.where("kind = 'single'"), 11, F.col("kind_rank"), F.col("description"), ("defect_type",),
                 (*found, "sample_size")),
        _section(recs.where(F.col("rec_rank") <= n_recs), 12, F.col("rec_rank"), F.col("category"), ("priority", "text")),
        _section(method, 13, F.col("i"), F.col("k"), ("text",)),
        _section(closing, 14, one, F.lit("note"), ("text",)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_summary(df: DataFrame, source: str) -> DataFrame:
    """S-7: loaded flag, rows, defect rate, date range, source label."""
    return df.agg(
        F.lit(True).alias("loaded"), F.count(F.lit(1)).alias("rows"),
        X.spark(X.round_half_up(X.safe_div("sum(defect_count) * 1e2", "sum(units_inspected)", "0e0"), 2))
        .alias("defect_rate_pct"),
        F.to_date(F.min("timestamp")).alias("date_min"), F.to_date(F.max("timestamp")).alias("date_max"),
        F.lit(source).alias("source"))
