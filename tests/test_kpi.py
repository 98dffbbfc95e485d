"""KPI semantics on small hand-made tables."""

import datetime as dt

from faultline.operators import kpi

SCHEMA = ("inspection_id string, timestamp timestamp_ntz, machine_id string, batch_id string, shift string, "
          "defect_type string, defect_count bigint, units_inspected bigint")


def _df(spark, rows):
    t = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(f"I{i}", t + dt.timedelta(days=i), *r) for i, r in enumerate(rows)], SCHEMA)


def test_pareto_falls_back_to_all_rows_when_only_no_defect_labels(spark):
    df = _df(spark, [("M1", "B1", "A", "Pass", 0, 100), ("M1", "B1", "A", "OK", 2, 100)])
    rows = kpi.pareto(df).collect()
    assert {r["defect_type"] for r in rows} == {"Pass", "OK"}
    assert rows[-1]["cumulative_pct"] == 100.0


def test_pareto_excludes_no_defect_labels_and_ends_at_100(spark):
    df = _df(spark, [("M1", "B1", "A", "No Defect", 0, 100), ("M1", "B1", "A", "Crack", 3, 100),
                     ("M2", "B1", "A", "Dent", 1, 100)])
    rows = sorted(kpi.pareto(df).collect(), key=lambda r: r["cumulative_pct"])
    assert [r["defect_type"] for r in rows] == ["Crack", "Dent"]
    assert rows[-1]["cumulative_pct"] == 100.0


def test_highest_risk_ties_go_to_first_sorted_member(spark):
    df = _df(spark, [("M2", "B1", "A", "Crack", 5, 100), ("M1", "B1", "B", "Crack", 5, 100)])
    got = {r["dimension"]: (r["member"], r["rate_pct"]) for r in kpi.highest_risk(df).collect()}
    assert got["machine_id"] == ("M1", 5.0)
    assert got["shift"] == ("A", 5.0)


def test_wilson_interval_brackets_rate(spark):
    df = _df(spark, [("M1", "B1", "A", "Crack", 3, 40), ("M2", "B1", "A", "Crack", 0, 10)])
    for r in kpi.rate_by(df, "machine_id").collect():
        assert r["ci_lower"] <= r["defect_rate_pct"] <= r["ci_upper"]


def test_contrast_without_units(spark):
    df = spark.createDataFrame([(0, 0, float(k)) for k in range(10)], "defect_count long, units_inspected long, temperature double")
    from faultline.operators import kpi
    row = kpi.parameter_contrast(df, params=("temperature",)).first()
    assert row["lift"] == 1.0 and row["finding"] == "Temperature > 8.10 is associated with a 0.00% defect rate (1.00x lift vs baseline 0.00%)."


def test_json_safe_reaches_nested_numbers(spark):
    from faultline.operators import findings
    df = spark.sql("SELECT double('NaN') AS a, named_struct('x', array(1.5D, double('Infinity')), 'm', map('k', double('-Infinity'))) AS s")
    row = findings.json_safe(df).first()
    assert row["a"] is None and row["s"]["x"] == [1.5, None] and row["s"]["m"] == {"k": None}


def test_line_items_are_not_shuffled_for_customers(spark):
    """Customers are joined to the orders, so that line items meet orders, suppliers and parts only."""
    from faultline.sources.fixtures import join_inspections

    j = join_inspections(spark, "/root/testdata/sf0.001", with_part_lot=True)
    plan = j._jdf.queryExecution().optimizedPlan()

    def tables(node):
        text = node.toString()
        return {t for t in ("l_orderkey", "o_orderkey", "c_custkey", "s_suppkey", "p_partkey") if t in text}

    joins, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Join":
            joins.append(tables(node))
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    assert {"o_orderkey", "c_custkey"} in joins
