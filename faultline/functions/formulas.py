"""Numeric formulas shared by the Spark operators and the SQL oracles.

Every formula is written once, as SQL expression text over named inputs.
Spark evaluates it through ``F.expr`` (so it stays a Catalyst expression inside
whole-stage codegen) and the DuckDB oracle embeds the very same text.  Writing
the arithmetic once keeps the order of floating-point operations identical in
both engines, so results agree bit for bit and not only "approximately".

Literals carry an exponent (``1.96e0``): Spark would otherwise read ``1.96`` as
a DECIMAL and change the result type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the analysed product's definitions.
# ---------------------------------------------------------------------------
# 95% two-sided normal quantile used by the Wilson interval.
Z95 = 1.96
# Pattern score weights, in the order they are summed:
# lift 0.30, significance 0.25, sample size 0.20, recurrence 0.15, effect size 0.10.
SCORE_WEIGHTS = (("lift", 0.30), ("significance", 0.25), ("sample_size", 0.20),
                 ("recurrence", 0.15), ("effect_size", 0.10))
# Association / confidence thresholds.
P_SIG = 0.05
P_HIGH = 0.01
LIFT_HIGH = 3.0
LIFT_MOD = 1.5
# Saturation scales of the score parts: lift 1.5, sample 2.5 (on ln(n/30)), effect 1 (on 40*|diff|).
LIFT_SCALE = 1.5
SAMPLE_BASE = 30.0
SAMPLE_SCALE = 2.5
EFFECT_GAIN = 40.0
# Numerical Recipes "erfcc" Chebyshev coefficients (fractional error < 1.2e-7).
ERFC_COEFFS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def lit(x: float) -> str:
    """Render a Python float as a DOUBLE literal understood by Spark SQL and DuckDB."""
    r = repr(float(x))
    if "e" in r or "E" in r or "inf" in r or "nan" in r:
        return r
    return r + "e0"


def col(name: str) -> str:
    """Quote a column name for both dialects (double quotes are ANSI in DuckDB,
    Spark accepts backticks); the result is only used inside formulas."""
    return f"`{name}`"


def spark(expr_text: str) -> Column:
    return F.expr(expr_text)


def to_duckdb(expr_text: str) -> str:
    """Spark quotes identifiers with backticks, DuckDB with double quotes."""
    return expr_text.replace("`", '"')


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def round_half_up(x: str, digits: int) -> str:
    """Deterministic decimal rounding: floor(x * 10^n + 0.5) / 10^n.

    Both engines perform the same IEEE operations, unlike their ``round``
    functions (Spark rounds the decimal string, DuckDB the binary product)."""
    scale = lit(10.0 ** digits)
    return f"(floor(({x}) * {scale} + 5e-1) / {scale})"


def safe_div(num: str, den: str, otherwise: str = "NULL") -> str:
    return f"(CASE WHEN ({den}) > 0 THEN {dbl(num)} / {dbl(den)} ELSE {otherwise} END)"


def rate(d: str, u: str) -> str:
    """Defect rate d/u as a fraction; null when there are no units."""
    return safe_div(d, u)


def rate_pct(d: str, u: str, digits: int = 2) -> str:
    """Rate in percent, rounded for display; 0 when there are no units."""
    return f"(CASE WHEN ({u}) > 0 THEN {round_half_up(f'{dbl(d)} / {dbl(u)} * 1e2', digits)} ELSE 0e0 END)"


def _wilson_parts(d: str, u: str) -> tuple[str, str]:
    p = f"({dbl(d)} / {dbl(u)})"
    n = dbl(u)
    z = lit(Z95)
    z2 = f"({z} * {z})"
    denom = f"(1e0 + {z2} / {n})"
    center = f"(({p} + {z2} / (2e0 * {n})) / {denom})"
    spread = (f"(({z} * sqrt(greatest(0e0, {p} * (1e0 - {p}) + {z2} / (4e0 * {n}))) "
              f"/ sqrt({n})) / {denom})")
    return center, spread


def wilson_lower_pct(d: str, u: str, digits: int = 2) -> str:
    """Lower bound of the 95% Wilson score interval, percent; 0 if u <= 0."""
    center, spread = _wilson_parts(d, u)
    v = f"(greatest(0e0, {center} - {spread}) * 1e2)"
    return f"(CASE WHEN ({u}) > 0 THEN {round_half_up(v, digits)} ELSE 0e0 END)"


def wilson_upper_pct(d: str, u: str, digits: int = 2) -> str:
    """Upper bound of the 95% Wilson score interval, percent; 0 if u <= 0."""
    center, spread = _wilson_parts(d, u)
    v = f"(least(1e0, {center} + {spread}) * 1e2)"
    return f"(CASE WHEN ({u}) > 0 THEN {round_half_up(v, digits)} ELSE 0e0 END)"


def erfc_nonneg(x: str) -> str:
    """Complementary error function for x >= 0 (Chebyshev fit, rel. error < 1.2e-7).

    Neither Spark nor DuckDB ships ``erf``; this is the same expression in both."""
    t = f"(1e0 / (1e0 + 5e-1 * ({x})))"
    horner = lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[1:-1]):
        horner = f"({lit(c)} + {t} * {horner})"
    return f"({t} * exp(-({x}) * ({x}) + {lit(ERFC_COEFFS[0])} + {t} * {horner}))"


def yates_chi2(a: str, b: str, c: str, d: str) -> str:
    """Pearson chi-square with Yates' continuity correction for [[a, b], [c, d]]."""
    a, b, c, d = dbl(a), dbl(b), dbl(c), dbl(d)
    n = f"({a} + {b} + {c} + {d})"
    dev = f"greatest(0e0, abs({a} * {d} - {b} * {c}) - {n} / 2e0)"
    den = f"(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}))"
    return f"({n} * {dev} * {dev} / {den})"


def chi2_pvalue(a: str, b: str, c: str, d: str) -> str:
    """p-value (df = 1) of the Yates-corrected 2x2 test; null when a cell < 1."""
    chi2 = yates_chi2(a, b, c, d)
    p = erfc_nonneg(f"sqrt({chi2} / 2e0)")
    return f"(CASE WHEN least({a}, {b}, {c}, {d}) >= 1 THEN {p} ELSE NULL END)"


def chi2_pvalue_staged(df, a: str, b: str, c: str, d: str, out: str, prefix: str = "_chi"):
    """Same value as :func:`chi2_pvalue`, built in steps (chi² → x → t → p) so each
    generated expression stays small enough for whole-stage codegen."""
    x, t = f"{prefix}_x", f"{prefix}_t"
    df = df.withColumn(x, F.expr(f"sqrt({yates_chi2(a, b, c, d)} / 2e0)"))
    df = df.withColumn(t, F.expr(f"1e0 / (1e0 + 5e-1 * `{x}`)"))
    horner = lit(ERFC_COEFFS[-1])
    for coef in reversed(ERFC_COEFFS[1:-1]):
        horner = f"({lit(coef)} + `{t}` * {horner})"
    p = f"(`{t}` * exp(-`{x}` * `{x}` + {lit(ERFC_COEFFS[0])} + `{t}` * {horner}))"
    df = df.withColumn(out, F.expr(f"CASE WHEN least({a}, {b}, {c}, {d}) >= 1 THEN {p} ELSE NULL END"))
    return df.drop(x, t)


def chi2_pvalue_sql_steps(a: str, b: str, c: str, d: str) -> tuple[str, str, str]:
    """The three staged expressions of :func:`chi2_pvalue_staged` for SQL (x, t, p over
    columns named ``_chi_x`` / ``_chi_t``)."""
    x = f"sqrt({yates_chi2(a, b, c, d)} / 2e0)"
    t = "1e0 / (1e0 + 5e-1 * `_chi_x`)"
    horner = lit(ERFC_COEFFS[-1])
    for coef in reversed(ERFC_COEFFS[1:-1]):
        horner = f"({lit(coef)} + `_chi_t` * {horner})"
    p = f"(`_chi_t` * exp(-`_chi_x` * `_chi_x` + {lit(ERFC_COEFFS[0])} + `_chi_t` * {horner}))"
    return x, t, f"CASE WHEN least({a}, {b}, {c}, {d}) >= 1 THEN {p} ELSE NULL END"


def saturate(x: str, scale: float) -> str:
    return f"(CASE WHEN ({x}) > 0e0 THEN 1e0 - exp(-({x}) / {lit(scale)}) ELSE 0e0 END)"


def score_lift(lift: str) -> str:
    return f"least({saturate(f'greatest({lift} - 1e0, 0e0)', LIFT_SCALE)}, 1e0)"


def score_significance(p: str) -> str:
    return f"least(1e0 - ({p}), 1e0)"


def score_sample(n: str) -> str:
    return f"least({saturate(f'ln(greatest({dbl(n)}, 1e0) / {lit(SAMPLE_BASE)})', SAMPLE_SCALE)}, 1e0)"


def score_effect(r_in: str, r_base: str) -> str:
    return f"least({saturate(f'abs(({r_in}) - ({r_base})) * {lit(EFFECT_GAIN)}', 1.0)}, 1e0)"


def composite_score(parts: dict[str, str]) -> str:
    """round(min(100, 100 * sum(w_i * s_i))) with the fixed weights, summed in order."""
    total = "0e0"
    for name, w in SCORE_WEIGHTS:
        total = f"({total} + {lit(w)} * ({parts[name]}))"
    return f"CAST({round_half_up(f'least(1e2, {total} * 1e2)', 0)} AS BIGINT)"


def association(lift: str, p: str) -> str:
    return (f"(CASE WHEN ({lift}) >= {lit(LIFT_HIGH)} AND ({p}) < {lit(P_HIGH)} THEN 'High' "
            f"WHEN ({lift}) >= {lit(LIFT_MOD)} AND ({p}) < {lit(P_SIG)} THEN 'Moderate' ELSE 'Low' END)")


def confidence(p: str) -> str:
    return (f"(CASE WHEN ({p}) < {lit(P_HIGH)} THEN 'High' WHEN ({p}) < {lit(P_SIG)} "
            f"THEN 'Moderate' ELSE 'Low' END)")


def p_display(p: str) -> str:
    """'<0.001' or the p-value with three decimals (half-up)."""
    return (f"(CASE WHEN ({p}) < 1e-3 THEN '<0.001' ELSE "
            f"{fixed_text(p, 3)} END)")


def sig6(x: str) -> str:
    """Round to six significant digits (the precision of printf's %g).

    Scales only by exact powers of ten (multiply when the shift is positive,
    divide otherwise) so the result does not depend on the engine's ``pow``."""
    k = f"(5e0 - floor(log10(abs({x}))))"
    up = f"pow(1e1, {k})"
    down = f"pow(1e1, -{k})"
    return (f"(CASE WHEN ({x}) = 0e0 OR ({x}) IS NULL THEN ({x}) "
            f"WHEN {k} >= 0e0 THEN floor(({x}) * {up} + 5e-1) / {up} "
            f"ELSE floor(({x}) / {down} + 5e-1) * {down} END)")


def g_text(x: str) -> str:
    """Text of a six-significant-digit value the way %g prints it in the usual range:
    integers without a decimal point, other values in shortest form."""
    return (f"(CASE WHEN ({x}) = floor({x}) AND abs({x}) < 1e15 "
            f"THEN CAST(CAST({x} AS BIGINT) AS STRING) ELSE CAST({x} AS STRING) END)")


def fixed_text(x: str, digits: int) -> str:
    """Fixed-point text with ``digits`` decimals, half-up, built from integer parts so both
    engines print the same characters (no thousands separators)."""
    scaled = f"CAST(floor(abs({x}) * {lit(10.0 ** digits)} + 5e-1) AS BIGINT)"
    int_part = f"CAST(floor({scaled} / {lit(10.0 ** digits)}) AS BIGINT)"
    frac = f"lpad(CAST({scaled} % {10 ** digits} AS STRING), {digits}, '0')"
    sign = f"(CASE WHEN ({x}) < 0e0 AND {scaled} > 0 THEN '-' ELSE '' END)"
    return f"concat({sign}, CAST({int_part} AS STRING), '.', {frac})"
