"""Bracketed exact quantile equals numpy's linear interpolation, including narrowing."""

import numpy as np
import pytest

from faultline.functions import quantile as QQ


@pytest.mark.parametrize("max_exact", [250_000, 50])
def test_exact_quantiles_match_numpy(spark, monkeypatch, max_exact):
    monkeypatch.setattr(QQ, "NARROW_ROWS", max_exact)
    rng = np.random.default_rng(7)
    a = rng.normal(100, 15, 20_000)
    b = rng.integers(0, 20, 20_000).astype(float)          # heavy ties
    c = np.where(rng.random(20_000) < 0.3, np.nan, rng.exponential(3, 20_000))
    df = spark.createDataFrame([(float(x), float(y), None if np.isnan(z) else float(z)) for x, y, z in zip(a, b, c)],
                               "a double, b double, c double")
    for p in (0.9, 0.5, 0.1):
        got = QQ.exact_quantiles(df, ["a", "b", "c"], p)
        assert got["a"] == pytest.approx(np.quantile(a, p), rel=1e-12)
        assert got["b"] == pytest.approx(np.quantile(b, p), rel=1e-12)
        assert got["c"] == pytest.approx(np.nanquantile(c, p), rel=1e-12)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None)] * 10, "a double, b double")
    got = QQ.exact_quantiles(df, ["a", "b"], 0.9)
    assert got == {"a": 1.0, "b": None}
