"""A cross-section of registered queries against their DuckDB oracles at sf0.001,
plus the driver contract of __spark_entry__."""

import datetime as dt
import os

import duckdb
import pytest

from faultline.plans.catalog import ORACLES, QUERIES, load_all

from conftest import SF_SMALL

load_all()
SAMPLE = ["k02_kpi_totals", "k08_defect_type_ranking", "k12_machine_ranking", "k14_parameter_contrast",
          "k20_batch_table", "t06_cusum", "t07_change_point", "p06_pattern_scores", "p12_slice_envelope",
          "c02_contribution_ranking", "r05_recommendations", "i16_validated_deduplicated", "m01_window_features",
          "st01_tumbling_daily_rate_by_machine", "r08_executive_summary"]


def _norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _canon(sdf.columns, [tuple(r) for r in sdf.collect()]) == _canon(dcols, cur.fetchall())


def test_entry_contract(spark):
    import importlib.util
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    qs, orc = mod.queries(), mod.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 80


def test_narratives_have_no_unfilled_placeholders(spark):
    for name in ("r08_executive_summary", "r09_findings_summary", "t10_trend_interpretation"):
        row = QUERIES[name](spark, SF_SMALL).first()
        text = [v for v in row if isinstance(v, str)][-1]
        assert "{" not in text and "}" not in text, (name, text)
