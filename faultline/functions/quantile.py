"""Exact linear-interpolation quantiles without pulling a whole column into one task.

``percentile`` (Spark's exact aggregate) merges every distinct value of a group into a
single final buffer; over a cluster-sized column that is one unbounded task.  Here the
exact value is found by narrowing a bracket instead:

1. one job: ``count``, ``min``, ``max`` and a KLL/GK sketch (``percentile_approx``) at
   ``p ± δ`` per column — bounded memory per task;
2. one job per round: count the rows below / inside the bracket; while it holds many rows and
   still shrinks, re-sketch inside it and narrow again (each round divides the bracket by
   about the sketch accuracy).  A bracket of one value is the answer, whatever its ties;
3. one job: add up rows per distinct value inside the bracket and read ranks k and k+1, so
   ties collapse before anything is ranked.

Only scalars reach the driver.  The result equals ``quantile_cont`` / pandas'
``quantile(..., interpolation='linear')``: ``v[k] + (v[k+1] - v[k]) * frac`` with
``pos = p * (n - 1)``, ``k = floor(pos)``, ``frac = pos - k``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000          # sketch accuracy: rank error <= n / ACCURACY
NARROW_ROWS = 250_000      # a bracket of more rows is narrowed as long as that makes it smaller


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(param, v) pairs, non-null values only (one narrow projection, no shuffle)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).cast("double").alias("v"))
                                for c in cols]))
    return df.select(pairs.alias("kv")).select("kv.param", "kv.v").where(F.col("v").isNotNull())


def exact_quantiles(df: DataFrame, cols: list[str], p: float) -> dict[str, float | None]:
    """Exact ``p``-quantile (linear interpolation) of each column; None for empty columns."""
    if not cols:
        return {}
    long = _long(df, cols)
    delta = 2.0 / ACCURACY
    # pass 1: one aggregate, no reshaping — count, min, max and a sketch per column
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.percentile_approx(v, [max(0.0, p - delta), min(1.0, p + delta)], ACCURACY).alias(f"br{i}")]
    r1 = df.agg(*aggs).first()
    stats = {c: {"n": r1[f"n{i}"], "lo_v": r1[f"lo{i}"], "hi_v": r1[f"hi{i}"], "br": r1[f"br{i}"]}
             for i, c in enumerate(cols)}
    out: dict[str, float | None] = {c: None for c in cols}
    todo: dict[str, dict] = {}
    for c in cols:
        r = stats.get(c)
        if r is None or r["n"] == 0:
            continue
        n = r["n"]
        pos = p * (n - 1)
        k = int(math.floor(pos))
        frac = pos - k
        need = k + 1 if frac == 0.0 or k + 1 >= n else k + 2   # rows up to rank k(+1), 1-based
        if r["lo_v"] == r["hi_v"]:
            out[c] = float(r["lo_v"])
            continue
        todo[c] = dict(n=n, k=k, frac=frac, need=need, lo=float(r["br"][0]), hi=float(r["br"][1]),
                       min=float(r["lo_v"]), max=float(r["hi_v"]))

    while todo:
        # pass 2: rows below / inside each bracket, one aggregate over the wide rows
        names = list(todo)
        aggs = []
        for i, c in enumerate(names):
            v, t = F.col(c).cast("double"), todo[c]
            aggs += [F.sum(F.when(v < t["lo"], 1).otherwise(0)).alias(f"b{i}"),
                     F.sum(F.when((v >= t["lo"]) & (v <= t["hi"]), 1).otherwise(0)).alias(f"i{i}")]
        r2 = df.agg(*aggs).first()
        ready = {}
        for i, c in enumerate(names):
            t, below, inside = todo[c], r2[f"b{i}"], r2[f"i{i}"]
            if below > t["k"]:                       # bracket too high: widen down
                t["lo"] = t["min"]
            elif below + inside < t["need"]:         # bracket too low: widen up
                t["hi"] = t["max"]
            elif t["lo"] == t["hi"]:                 # both ranks are this value
                out[c] = t["lo"]
                todo.pop(c)
            else:
                t["below"] = below
                stuck = t.get("inside") == inside
                t["inside"] = inside
                if inside <= NARROW_ROWS or stuck:
                    ready[c] = todo.pop(c)
                    continue
                inner = long.where((F.col("param") == c) & (F.col("v") >= t["lo"]) & (F.col("v") <= t["hi"]))
                q_lo = max(0.0, (t["k"] - below) / inside - delta)
                q_hi = min(1.0, (t["need"] - below) / inside + delta)
                br = inner.agg(F.percentile_approx("v", [q_lo, q_hi], ACCURACY)).first()[0]
                t["lo"], t["hi"] = float(br[0]), float(br[1])
        if ready:
            out.update(_pick_ranks(long, ready))
    return out


def _pick_ranks(long: DataFrame, ready: dict[str, dict]) -> dict[str, float]:
    cond = F.lit(False)
    for c, t in ready.items():
        cond = cond | ((F.col("param") == c) & (F.col("v") >= t["lo"]) & (F.col("v") <= t["hi"]))
    counted = long.where(cond).groupBy("param", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("param").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("last", F.sum("n").over(upto)).withColumn("first", F.col("last") - F.col("n") + 1)
    want = F.lit(False)
    for c, t in ready.items():
        r1 = t["k"] - t["below"] + 1
        want = want | ((F.col("param") == c) & (F.col("first") <= r1 + 1) & (F.col("last") >= r1))
    vals: dict[str, dict[int, float]] = {}
    for r in ranked.where(want).collect():   # at most two values per column
        t = ready[r["param"]]
        for rank in (t["k"] - t["below"] + 1, t["k"] - t["below"] + 2):
            if r["first"] <= rank <= r["last"]:
                vals.setdefault(r["param"], {})[rank] = r["v"]
    out = {}
    for c, t in ready.items():
        r1 = t["k"] - t["below"] + 1
        lo = vals[c][r1]
        hi = vals[c].get(r1 + 1, lo)
        out[c] = lo + (hi - lo) * t["frac"] if t["frac"] else lo
    return out
