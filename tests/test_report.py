"""Context record and report over small inputs, whole and empty."""

import datetime as dt

import pytest

from faultline.operators import findings as R

TOTALS = "inspection_records long, units_inspected long, defective_units long, defect_rate_pct double, date_min date, date_max date, days_span long"
RANKING = ("{key} string, defect_count long, units_inspected long, inspection_count long, defect_rate_pct double, "
           "ci_lower double, ci_upper double, display_summary string, risk_rank long, status string")
PATTERNS = ("rank long, pattern_id string, description string, defect_type string, slice_rate double, baseline_rate double, "
            "lift double, sample_size long, p_display string, pattern_score long, factor_count int")
RECS = "rec_rank long, pattern_id string, category string, priority string, text string"
CPS = "cp_date date, direction string, before_rate double, after_rate double, cusum_value double"


def frames(spark, full: bool):
    def df(rows, schema):
        return spark.createDataFrame(rows if full else [], schema)

    day = dt.date(2024, 1, 2)
    total = (6, 60, 3, 5.0, day, day, 1) if full else (0, 0, 0, 0.0, None, None, None)
    member = (2, 40, 4, 5.0, 1.0, 9.0, "s", 1, "Highest-risk")
    return {
        "totals": spark.createDataFrame([total], TOTALS),
        "risk": df([("machine_id", "M1", 5.0), ("shift", "A", 5.0)], "dimension string, member string, rate_pct double"),
        "types": df([("scratch",), ("dent",)], "defect_type string"),
        "patterns": df([(i, f"P-{i:03d}", f"slice {i}", "dent", 9.0, 3.0, 3.0, 40, "0.010", 90 - i, 1 + i % 2)
                        for i in range(1, 26)], PATTERNS),
        "cps": df([(day, "up", 0.1, 0.2, 5.0)], CPS),
        "recs": df([(i, f"P-{i:03d}", "machine", "High", 'say "so"\n') for i in range(1, 13)], RECS),
        "machines": df([("M1", *member), ("M2", *member[:-2], 2, "Normal operation")], RANKING.format(key="machine_id")),
        "shifts": df([("A", *member)], RANKING.format(key="shift"))}


@pytest.mark.parametrize("full", [True, False])
def test_context_record_reads_back(spark, full):
    f = frames(spark, full)
    record = R.context_record(**f, alerts=f["cps"] if full else None)
    assert record.count() == 1
    got = {}
    for r in R.read_context(record).collect():
        got.setdefault((r.part, r.field), []).append((r.position, r.value))
    assert got["record", "active_alerts"] == [(0, "1" if full else "0")]
    assert got["record", "total_inspections"] == [(0, "6" if full else "0")]
    assert got["record", "highest_risk_shift"] == [(0, "A" if full else None)]
    if not full:
        assert {p for p, _ in got} == {"record"}
        return
    assert sorted(got["defect_types", "defect_type"]) == [(1, "dent"), (2, "scratch")]
    assert sorted(got["machine_analysis", "machine_id"]) == [(1, "M1"), (2, "M2")]
    assert len(got["top_patterns", "lift"]) == 10 and len(got["recommendations", "text"]) == 8
    assert {v for _, v in got["recommendations", "text"]} == {'say "so"\n'}


@pytest.mark.parametrize("full", [True, False])
def test_report_has_every_section(spark, full):
    f = frames(spark, full)

    def df(rows, schema):
        return spark.createDataFrame(rows if full else [], schema)

    report = R.full_report(
        f["totals"], spark.createDataFrame([("said",)], "executive_summary string"),
        df([(0, "2024-01", 0.05)], "idx long, period string, defect_rate double"),
        spark.createDataFrame([("flat",)], "text string"), f["machines"], f["shifts"],
        df([("dent", 3, 5.0, 100.0, 1)], "defect_type string, defect_count long, defect_rate_pct double, share_of_total_defects_pct double, rank long"),
        df([("M1", "A", 4.0)], "machine_id string, shift string, defect_rate_pct double"),
        df([("speed", "Available", 1.0, 2.0, 1.0, 2.0)], "parameter string, status string, threshold_q90 double, high_threshold_rate_pct double, baseline_rate_pct double, lift double"),
        f["patterns"], f["recs"], "here").collect()
    sections = {}
    for r in report:
        sections.setdefault(r.section, []).append(r)
        assert r.title == R.REPORT_TITLES[r.section - 1]
    assert set(sections) == (set(range(1, 15)) if full else {1, 2, 3, 4, 13, 14})
    counted = {r.field: r.number for r in sections[2]}
    assert (counted["machines"], counted["shifts"]) == ((2.0, 1.0) if full else (0.0, 0.0))
    if full:
        assert {r.field: r.number for r in sections[8]} == {"defect_rate_pct": 4.0, "mean_of_margins_pct": 5.0}
        assert len({r.position for r in sections[10]}) == 10 and len({r.position for r in sections[11]}) == 8
        assert len({r.position for r in sections[12]}) == 10
