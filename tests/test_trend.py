"""The HOF folds (EWMA, rolling z, CUSUM) equal a plain sequential loop."""

import math

import pytest

from faultline.operators import trend
from faultline.sources.fixtures import event_inspections, inspections

from conftest import SF_MID, SF_SMALL


def reference_loop(r, k=0.5, h=5.0, win=14):
    n = len(r)
    b = max(2, min(win, max(2, n // 2)))
    ew, z_trend, sp, sm = [], [0.0] * n, [0.0] * n, [0.0] * n
    for i, x in enumerate(r):
        ew.append(x if i == 0 else 0.75 * ew[-1] + 0.25 * x)
    for i in range(b, n):
        w = r[i - b:i]
        mu = sum(w) / len(w)
        sd = math.sqrt(sum((v - mu) ** 2 for v in w) / (len(w) - 1))
        z = (r[i] - mu) / sd if sd > 0 else 0.0
        z_trend[i] = z
        sp[i] = max(0.0, sp[i - 1] + z - k)
        sm[i] = max(0.0, sm[i - 1] - z - k)
    if n < b + 1:
        sp, sm = [0.0] * n, [0.0] * n
    return ew, z_trend, sp, sm


@pytest.mark.parametrize("sf,events", [(SF_MID, False), (SF_SMALL, True)])
def test_folds_match_loop(spark, sf, events):
    df = event_inspections(spark, sf) if events else inspections(spark, sf)
    rows = trend.trend_series(df).orderBy("idx").collect()
    r = [x["defect_rate"] for x in rows]
    ew, zt, sp, sm = reference_loop(r)
    for i, x in enumerate(rows):
        assert x["ewma"] == pytest.approx(ew[i], rel=1e-12, abs=1e-15)
        assert x["z_trend"] == pytest.approx(zt[i], rel=1e-9, abs=1e-12)
        assert x["cusum_pos"] == pytest.approx(sp[i], rel=1e-9, abs=1e-12)
        assert x["cusum_neg"] == pytest.approx(sm[i], rel=1e-9, abs=1e-12)
        assert x["cusum_pos"] >= 0 and x["cusum_neg"] >= 0


def test_fixture_facts_sf001(spark):
    s = trend.trend_series(inspections(spark, SF_MID))
    rows = s.collect()
    assert len(rows) == 83                                   # monthly grain over 83 months
    assert sum(x["spike_flag"] for x in rows) == 1
    cp = trend.change_points(s).collect()
    assert len(cp) == 1 and cp[0]["direction"] == "down" and cp[0]["cp_period"] == "1998-03"


def test_interpretation_of_short_series(spark):
    from faultline.operators import trend
    kind = ("idx bigint, period string, period_start date, units bigint, defects bigint, defect_rate double, cusum_pos double, "
            "cusum_neg double, cusum_flag int")
    one = spark.createDataFrame([(0, "2026-01-01", None, 10, 1, 0.1, 0.0, 0.0, 0)], kind)
    assert trend.interpretation(one, trend.change_points(one)).first()["text"] == trend.SHORT_SERIES
    none = one.limit(0)
    assert trend.interpretation(none, trend.change_points(none)).first()["text"] == trend.EMPTY_SERIES
