"""Shared formulas: Spark evaluation vs plain-Python statements of the same maths."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.functions import formulas as X


def wilson(d, u, z=1.96):
    if u <= 0:
        return 0.0, 0.0, 0.0
    p = d / u
    den = 1 + z * z / u
    c = (p + z * z / (2 * u)) / den
    s = (z * math.sqrt(max(0.0, p * (1 - p) + z * z / (4 * u))) / math.sqrt(u)) / den
    return p * 100, max(0.0, c - s) * 100, min(1.0, c + s) * 100


def yates_p(a, b, c, d):
    n = a + b + c + d
    chi2 = n * max(0.0, abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    return math.erfc(math.sqrt(chi2 / 2))


def test_wilson_and_rate(spark):
    rows = [(3, 100), (0, 50), (50, 50), (7, 0), (1234, 98765)]
    df = spark.createDataFrame(rows, "d long, u long")
    got = df.select(X.spark(X.rate_pct("`d`", "`u`", 6)).alias("r"), X.spark(X.wilson_lower_pct("`d`", "`u`", 6)).alias("lo"),
                    X.spark(X.wilson_upper_pct("`d`", "`u`", 6)).alias("hi")).collect()
    for (d, u), g in zip(rows, got):
        r, lo, hi = wilson(d, u)
        assert g["r"] == pytest.approx(r, abs=1e-6)
        assert g["lo"] == pytest.approx(lo, abs=1e-6)
        assert g["hi"] == pytest.approx(hi, abs=1e-6)
        assert g["lo"] <= g["r"] + 1e-9 <= g["hi"] + 2e-9


def test_erfc_accuracy(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.5, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(X.spark(X.erfc_nonneg("`x`"))).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.erfc(x), rel=2e-7, abs=1e-12)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 500), st.integers(1, 5000), st.integers(1, 500), st.integers(1, 5000))
def test_chi2_pvalue_matches_closed_form(spark, a, b, c, d):
    df = spark.createDataFrame([(a, b, c, d)], "a long, b long, c long, d long")
    got = df.select(X.spark(X.chi2_pvalue("`a`", "`b`", "`c`", "`d`"))).first()[0]
    assert got == pytest.approx(yates_p(a, b, c, d), rel=1e-6, abs=1e-9)


def test_chi2_null_when_cell_empty(spark):
    df = spark.createDataFrame([(0, 10, 5, 10)], "a long, b long, c long, d long")
    assert df.select(X.spark(X.chi2_pvalue("`a`", "`b`", "`c`", "`d`"))).first()[0] is None


def test_sig6_and_g_text_match_printf_g(spark):
    xs = [9674.017666666667, 0.07, 46.0, 9013.59, 78.253, 0.723456789, 123456.7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(X.spark(X.g_text(X.sig6("`x`")))).collect()]
    assert got == [f"{x:g}" for x in xs]


def test_fixed_text_and_p_display(spark):
    df = spark.createDataFrame([(0.0004,), (0.01234,), (0.5,), (2.0,)], "p double")
    got = [r[0] for r in df.select(X.spark(X.p_display("`p`"))).collect()]
    assert got == ["<0.001", "0.012", "0.500", "2.000"]


def test_composite_score_bounds(spark):
    parts = {"lift": "1e0", "significance": "1e0", "sample_size": "1e0", "recurrence": "1e0", "effect_size": "1e0"}
    assert spark.range(1).select(X.spark(X.composite_score(parts))).first()[0] == 100
    parts = {k: "0e0" for k in parts}
    assert spark.range(1).select(X.spark(X.composite_score(parts))).first()[0] == 0
