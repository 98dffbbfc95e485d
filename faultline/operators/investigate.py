"""Root-cause investigation for one defect type.

* contribution ranking: one unpivot + one aggregate over every (factor, value) pair,
  chi-square and lift as column expressions;
* mutual information by two estimators: plug-in over (bin, label) counts, numerics in
  quantile bins, and k nearest neighbours in one dimension, over distinct values with counts;
* a shallow decision tree with exact thresholds, grown level by level from counts per
  (node, feature, value) with prefix sums over range partitions.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import formulas as X
from faultline.functions import prefix
from faultline.functions.quantile import exact_quantiles
from faultline.session import broadcast_if_small, materialize
from faultline.sources.fixtures import PARAMS

CATS = ["machine_id", "shift", "batch_id"]
FACTOR_LABEL = {"machine_id": "Machine", "shift": "Shift", "batch_id": "Batch"}
MIN_ROWS = 30              # fixed: rows needed in a slice
TOP_FACTORS = 25
MI_BINS, MI_NEIGHBOURS = 10, 3
TREE_DEPTH = 3
TREE_MIN_LEAF = 50
TOP_SPLITS = 6
MIN_GAIN = 1e-7            # a split must lower rows x impurity by more than rounding does


def factor_label(col: str) -> str:
    """C-3: Machine / Shift / Batch / title-cased parameter name."""
    if col in FACTOR_LABEL:
        return FACTOR_LABEL[col]
    if col.endswith("_bucket"):
        return col[:-7].title()
    return col.title()


def target_baseline(df: DataFrame, defect_type: str) -> DataFrame:
    """C-1: units, defects and rate among rows of the type, next to the global rate."""
    is_t = F.col("defect_type") == defect_type
    t = df.agg(F.sum(F.when(is_t, F.col("units_inspected")).otherwise(0)).alias("target_units"),
               F.sum(F.when(is_t, F.col("defect_count")).otherwise(0)).alias("target_defects"),
               F.sum("units_inspected").alias("u"), F.sum("defect_count").alias("d"))
    return t.select(F.lit(defect_type).alias("defect_type"), "target_units", "target_defects",
                    X.spark(X.rate_pct("`target_defects`", "`target_units`")).alias("target_rate"),
                    X.spark(X.round_half_up(X.safe_div("`d` * 1e2", "`u`", "0e0"), 2)).alias("baseline_rate"))


def contribution(df: DataFrame, defect_type: str, reference_cells: bool = False,
                 top: int | None = TOP_FACTORS, max_levels: int | None = None,
                 thresholds: dict[str, float | None] | None = None) -> DataFrame:
    """C-2: per value of every factor (≥ 30 rows; with ``max_levels``, factors of at most so many values): rate of the type inside
    vs outside, lift ≥ 1, Yates p; sorted by lift desc, p asc; first ``top``.

    ``reference_cells=True`` reproduces the fourth contingency cell of the original
    (outside units instead of outside non-defective units).  ``thresholds``: the parameters' p90, where
    the caller has them already (one call of ``exact_quantiles`` serves several analyses)."""
    params = [p for p in PARAMS if p in df.columns]
    q = thresholds if thresholds is not None else exact_quantiles(df, params, 0.9)
    params = [p for p in params if q.get(p) is not None]
    pairs = [F.struct(F.lit(c).alias("factor_col"), F.col(c).cast("string").alias("factor_value")) for c in CATS]
    for p in params:
        txt = X.spark(X.g_text(X.sig6(X.lit(q[p]))))
        above = F.coalesce(F.col(p) > F.lit(q[p]), F.lit(False))
        pairs.append(F.struct(F.lit(f"{p}_bucket").alias("factor_col"),
                              F.when(above, F.concat(F.lit(">"), txt)).otherwise(F.concat(F.lit("<="), txt))
                              .alias("factor_value")))
    is_t = F.col("defect_type") == defect_type
    long = df.select(F.explode(F.array(*pairs)).alias("kv"), is_t.alias("is_t"), "units_inspected", "defect_count")
    g = long.groupBy("kv.factor_col", "kv.factor_value").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("is_t"), F.col("units_inspected")).otherwise(0)).alias("tot_in"),
        F.sum(F.when(F.col("is_t"), F.col("defect_count")).otherwise(0)).alias("def_in"))
    tot = df.agg(F.sum(F.when(is_t, F.col("units_inspected")).otherwise(0)).alias("tu"),
                 F.sum(F.when(is_t, F.col("defect_count")).otherwise(0)).alias("td"),
                 X.spark(X.safe_div("sum(defect_count)", "sum(units_inspected)", "0e0")).alias("gr"))
    # number of values per factor: a grouped count joined back (one row per factor) —
    # a window partitioned by factor would put all values of a wide factor in one task
    if max_levels is not None:
        levels = g.groupBy("factor_col").agg(F.count(F.lit(1)).alias("levels")).where(F.col("levels") <= max_levels)
        g = g.join(F.broadcast(levels), "factor_col", "left_semi")          # ≤ one row per factor (8): bounded
    g = (g.withColumn("target_units", tot.select("tu").scalar())
          .withColumn("target_defects", tot.select("td").scalar())
          .withColumn("global_rate", tot.select("gr").scalar()))
    g = g.where(F.col("n") >= MIN_ROWS)
    g = (g.withColumn("def_out", F.col("target_defects") - F.col("def_in"))
          .withColumn("tot_out", F.col("target_units") - F.col("tot_in"))
          .withColumn("r_in", X.spark(X.safe_div("`def_in`", "`tot_in`", "0e0")))
          .withColumn("r_out", X.spark(X.safe_div("`def_out`", "`tot_out`", "`global_rate`")))
          .withColumn("lift_raw", F.when(F.col("r_out") > 0, F.col("r_in") / F.col("r_out"))))
    fourth = "`tot_out`" if reference_cells else "(`tot_out` - `def_out`)"
    g = g.where(F.col("lift_raw").isNotNull() & (F.col("lift_raw") >= 1.0))
    g = X.chi2_pvalue_staged(g, "`def_in`", "(`tot_in` - `def_in`)", "`def_out`", fourth, "p_raw")
    g = g.where(F.col("p_raw").isNotNull())
    g = (g.withColumn("lift", X.spark(X.round_half_up("`lift_raw`", 2)))
          .withColumn("p_value", X.spark(X.round_half_up("`p_raw`", 4))))
    order = F.create_map(*[x for i, c in enumerate(CATS + [f"{p}_bucket" for p in params])
                           for x in (F.lit(c), F.lit(i))])[F.col("factor_col")]
    by = [F.col("lift").desc(), F.col("p_value").asc(), order, F.col("factor_value")]
    if top is not None:
        g = g.orderBy(*by).limit(top)              # every task sends its first rows only
    g = g.withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("bigint"))
    label = F.create_map(*[x for c in CATS + [f"{p}_bucket" for p in params]
                           for x in (F.lit(c), F.lit(factor_label(c)))])[F.col("factor_col")]
    return g.select(
        "rank", label.alias("factor"), "factor_value",
        X.spark(X.association("`lift_raw`", "`p_raw`")).alias("association"),
        X.spark(X.round_half_up("`r_in` * 1e2", 2)).alias("defect_rate_in"),
        X.spark(X.round_half_up("`r_out` * 1e2", 2)).alias("baseline_rate"),
        "lift", F.col("n").alias("sample_size"), "p_value",
        X.spark(X.p_display("`p_raw`")).alias("p_display"))


def _features(df: DataFrame) -> list[str]:
    return CATS + [p for p in PARAMS if p in df.columns]


def target_counts(df: DataFrame, defect_type: str) -> DataFrame:
    """feature, num, txt, y, n: rows per value of every feature and target; stored."""
    none = F.lit(None)
    pairs = [F.struct(F.lit(c).alias("feature"), (none if c in CATS else F.col(c)).cast("double").alias("num"),
                      (F.col(c) if c in CATS else none).cast("string").alias("txt")) for c in _features(df)]
    y = F.coalesce((F.col("defect_type") == defect_type).cast("int"), F.lit(0)).alias("y")
    return materialize(df.select(y, F.explode(F.array(*pairs)).alias("x")).groupBy("x.feature", "x.num", "x.txt", "y").agg(
        F.count(F.lit(1)).alias("n")), "target-counts")


def quantiles_of_counts(counts: DataFrame, ps: list[float]) -> dict[str, list[float]]:
    """Exact linear-interpolation quantiles of every numeric feature of ``counts`` (feature, num, n)."""
    values = counts.where("num is not null").groupBy("feature", "num").agg(F.sum("n").alias("n"))
    ranked = prefix.running_sum(prefix.spread(values, ["feature"], ["num"]), ["feature"], ["num"], "n", "upto")
    sizes = {r["feature"]: r["n"] for r in values.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    want, places = F.lit(False), {}
    for c, n in sizes.items():
        for p in ps:
            low = math.floor(p * (n - 1))
            places[c, p] = (low, min(low + 1, n - 1), p * (n - 1) - low)
            for k in places[c, p][:2]:
                want = want | ((F.col("feature") == c) & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k))
    held = [(r["feature"], r["upto"] - r["n"], r["upto"], r["num"]) for r in ranked.where(want).collect()]   # 2 values a quantile at most

    def at(c: str, k: int) -> float:
        return next(v for f, lo, hi, v in held if f == c and lo <= k < hi)

    return {c: [at(c, a) + (at(c, b) - at(c, a)) * w if w else at(c, a) for a, b, w in (places[c, p] for p in ps)] for c in sizes}


def mutual_information(df: DataFrame, defect_type: str, bins: int = MI_BINS) -> DataFrame:
    """C-5, first estimator: plug-in MI (nats) between each factor and ``defect_type == t``, numerics
    in ``bins`` bins between their exact quantiles (a null is a bin of its own); sorted desc."""
    counts = target_counts(df, defect_type)
    edges = quantiles_of_counts(counts, [i / bins for i in range(1, bins)])
    place = F.when(F.col("num").isNull(), F.lit(-1))
    for c, held in edges.items():
        place = place.when(F.col("feature") == c, sum((F.col("num") > F.lit(e)).cast("int") for e in sorted(set(held))))
    bin_ = F.when(F.col("feature").isin(*CATS), F.col("txt")).otherwise(place.cast("string"))
    cells = counts.groupBy("feature", bin_.alias("bin")).agg(F.sum("n").alias("nx"), F.sum(F.col("n") * F.col("y")).alias("nx1"))
    total = counts.where(F.col("feature") == CATS[0]).agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("y")).alias("N1"))
    cells = (cells.withColumn("N", total.select("N").scalar()).withColumn("N1", total.select("N1").scalar())
                  .withColumn("nx0", F.col("nx") - F.col("nx1")))
    term = (f"(CASE WHEN `nx1` > 0 THEN CAST(`nx1` AS DOUBLE) / CAST(`N` AS DOUBLE) * ln(CAST(`nx1` AS DOUBLE) * CAST(`N` AS DOUBLE) / (CAST(`nx` AS DOUBLE) * CAST(`N1` AS DOUBLE))) ELSE 0e0 END"
            f" + CASE WHEN `nx0` > 0 THEN CAST(`nx0` AS DOUBLE) / CAST(`N` AS DOUBLE) * ln(CAST(`nx0` AS DOUBLE) * CAST(`N` AS DOUBLE) / (CAST(`nx` AS DOUBLE) * CAST(`N` - `N1` AS DOUBLE))) ELSE 0e0 END)")
    return _ranked_information(cells.groupBy("feature").agg(F.sum(X.spark(term)).alias("mi")))


def _ranked_information(mi: DataFrame) -> DataFrame:
    w = Window.orderBy(F.col("mutual_information").desc(), F.col("feature"))   # one row per feature
    return (mi.select("feature", X.spark(X.round_half_up("greatest(`mi`, 0e0)", 6)).alias("mutual_information"))
              .withColumn("rank", F.row_number().over(w).cast("bigint")))


def digamma(x: str) -> str:
    """Digamma of a whole number from 1 up (relative error below 1e-10), as text for both engines."""
    up = f"(CAST({x} AS DOUBLE) + 6e0)"
    steps = " - ".join(f"1e0 / (CAST({x} AS DOUBLE) + {i}e0)" for i in range(6))
    sq = f"({up} * {up})"
    return f"(ln({up}) - 5e-1 / {up} - 1e0 / (12e0 * {sq}) + 1e0 / (120e0 * {sq} * {sq}) - 1e0 / (252e0 * {sq} * {sq} * {sq}) - {steps})"


def knn_mutual_information(df: DataFrame, defect_type: str, k: int = MI_NEIGHBOURS) -> DataFrame:
    """C-5, second estimator: nearest-neighbour MI (nats) between each feature, taken as a number, and
    ``defect_type == t``.  Categoricals are their places in text order (null: -1), null numerics the median.

    For a row x of a class of n_c rows, r is the distance to its k-th nearest row of the class and m
    the number of all rows nearer than r (of equal ones if r is 0), x included:
    MI = psi(N) + <psi(k)> - <psi(n_c)> - <psi(m)>.  Equal values are one record with a count, so ties
    cost nothing; distances look at k values on each side, m is a difference of two running counts."""
    counts = target_counts(df, defect_type)
    middle = quantiles_of_counts(counts, [0.5])
    places = counts.where(F.col("feature").isin(*CATS) & F.col("txt").isNotNull()).select("feature", "txt").distinct().withColumn("one", F.lit(1))
    places = prefix.running_sum(prefix.spread(places, ["feature"], ["txt"]), ["feature"], ["txt"], "one", "place").select(
        "feature", "txt", (F.col("place") - 1).cast("double").alias("place"))
    fill = F.lit(0.0)
    for c, (v,) in middle.items():
        fill = F.when(F.col("feature") == c, F.lit(v)).otherwise(fill)
    value = F.when(F.col("feature").isin(*CATS), F.coalesce("place", F.lit(-1.0))).otherwise(F.coalesce("num", fill))
    cells = counts.join(broadcast_if_small(materialize(places, "places")), ["feature", "txt"], "left").select(
        "feature", "y", value.alias("v"), "n").groupBy("feature", "y", "v").agg(F.sum("n").alias("n"))
    sizes = counts.where(F.col("feature") == CATS[0]).groupBy("y").agg(F.sum("n").alias("nc")).where("nc > 1")   # two rows at most
    cells = cells.join(F.broadcast(sizes.withColumn("k", F.least(F.lit(k), F.col("nc") - 1))), "y")
    held = prefix.neighbours(prefix.spread(cells, ["feature", "y"], ["v"]), ["feature", "y"], "v", F.struct("v", "n"), k, "beside")
    near = F.array_sort(F.transform("beside", lambda x: F.struct(F.abs(x["v"] - F.col("v")).alias("d"), x["n"].alias("n"))))
    # the first distance at which k others are found; the row's own value counts n - 1 of them
    r = F.aggregate(near, F.struct(F.col("n") - 1, F.lit(0.0).alias("r")).cast("struct<s: bigint, r: double>"),
                    lambda acc, x: F.when(acc["s"] >= F.col("k"), acc).otherwise(
                        F.struct((acc["s"] + x["n"]).alias("s"), x["d"].alias("r"))), lambda acc: acc["r"])
    points = materialize(held.select("feature", "y", "v", "n", "nc", "k", r.alias("r")), "radii")
    # running counts of all rows at both ends of the open interval; kind 0 comes before equal values, 2 behind
    tie = F.col("r") == 0
    ends = points.select("feature", "y", "v", F.explode(F.array(
        F.struct((F.col("v") + F.col("r")).alias("x"), F.when(tie, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
        F.struct((F.col("v") - F.col("r")).alias("x"), F.when(tie, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")))).alias("e")).select(
        "feature", "e.x", "e.kind", F.lit(0).cast("bigint").alias("n"), "e.sign", "y", "v")
    values = points.groupBy("feature", F.col("v").alias("x")).agg(F.sum("n").alias("n")).select(
        "feature", "x", F.lit(1).alias("kind"), "n", F.lit(0).alias("sign"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("double").alias("v"))
    line = prefix.spread(values.unionByName(ends), ["feature"], ["x", "kind"])
    line = prefix.running_sum(line, ["feature"], ["x", "kind"], "n", "upto")
    m = line.where("kind <> 1").groupBy("feature", "y", "v").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    parts = points.join(m, ["feature", "y", "v"]).groupBy("feature").agg(
        F.sum("n").alias("N"), F.sum(F.col("n") * X.spark(f"{digamma('k')} - {digamma('nc')} - {digamma('m')}")).alias("s"))
    return _ranked_information(parts.select("feature", (X.spark(digamma("N")) + F.col("s") / F.col("N")).alias("mi")))


def ordinal_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Alphabetical 0-based code of ``col`` without gathering its values anywhere: the
    distinct values are range-sorted across the cluster, numbered by per-partition
    offsets, stored, and joined back (broadcast if counted as small, else by a shuffle)."""
    from faultline.operators.ingest import with_position
    codes = with_position(df.select(F.col(col).cast("string").alias("_v")).distinct().orderBy("_v"))
    codes = materialize(codes.select(F.col("_v").alias(col), F.col("_pos").cast("double").alias(out)), "codes")
    return df.join(broadcast_if_small(codes), col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1.0)))


def feature_frame(df: DataFrame, defect_type: str | None = None):
    """C-4: ordinal-encoded categoricals (alphabetical codes, null → -1; the same encoding at any
    number of values), numerics with nulls replaced by the exact median, in one vector column."""
    params = [p for p in PARAMS if p in df.columns]
    src = df.select(*CATS, *[F.col(p).cast("double").alias(p) for p in params], "defect_type")
    for c in CATS:
        src = ordinal_encode(src, c, f"{c}_idx")
    middle = exact_quantiles(src, params, 0.5)
    out = src.select("*", *[F.coalesce(F.col(p), F.lit(middle[p]), F.lit(0.0)).alias(f"{p}_imp") for p in params])
    out = VectorAssembler(inputCols=[f"{c}_idx" for c in CATS] + [f"{p}_imp" for p in params], outputCol="features").transform(out)
    if defect_type is not None:
        out = out.withColumn("label", (F.col("defect_type") == defect_type).cast("double"))
    return out, CATS + params


def _left(feature: str, num: float | None, txt: str | None, middle: dict):
    """Whether a row goes left: its value is at most the boundary's (text in its own order, null first)."""
    if feature in CATS:
        return F.col(feature).isNull() | (F.col(feature).cast("string") <= F.lit(txt)) if txt is not None else F.col(feature).isNull()
    return _filled(feature, middle) <= F.lit(num)


def _filled(param: str, middle: dict):
    return F.coalesce(F.col(param).cast("double"), F.lit(middle[param]), F.lit(0.0))


def value_counts(rows: DataFrame, names: list[str], middle: dict) -> DataFrame:
    """node, f (feature's place), num, txt, n, n1: rows and target rows per node, feature and value."""
    none = F.lit(None)
    pairs = [F.struct(F.lit(i).alias("f"), (none if c in CATS else _filled(c, middle)).cast("double").alias("num"),
                      (F.col(c) if c in CATS else none).cast("string").alias("txt")) for i, c in enumerate(names)]
    return rows.select("node", "y", F.explode(F.array(*pairs)).alias("x")).groupBy("node", "x.f", "x.num", "x.txt").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))


def split_candidates(counts: DataFrame, min_leaf: int) -> DataFrame:
    """Every boundary between two neighbouring values of a (node, feature), with what lies left of it.

    Values are range-partitioned and sorted once; running sums are made inside each partition and
    shifted by the totals of the partitions before it, so no feature has to fit in a task."""
    by = ["node", "f"]
    spread = counts.repartitionByRange("node", "f", "num", "txt").withColumn("part", F.spark_partition_id())
    spread = materialize(spread, "value-counts")
    least = F.min(F.struct("num", "txt")).alias("first")
    totals = spread.groupBy(*by, "part").agg(F.sum("n").alias("sn"), F.sum("n1").alias("s1"), least)     # a row per partition
    order = Window.partitionBy(*by).orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(*by, "part", F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("bn"),
                           F.coalesce(F.sum("s1").over(before), F.lit(0)).alias("b1"), F.sum("sn").over(whole).alias("tn"),
                           F.sum("s1").over(whole).alias("t1"), F.lead("first").over(order).alias("after"))
    inside = Window.partitionBy(*by, "part").orderBy("num", "txt")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    run = spread.select("*", F.sum("n").over(upto).alias("rn"), F.sum("n1").over(upto).alias("r1"),
                        F.lead(F.struct("num", "txt")).over(inside).alias("next"))
    out = run.join(totals, [*by, "part"]).select(
        *by, "num", "txt", (F.col("bn") + F.col("rn")).alias("nl"), (F.col("b1") + F.col("r1")).alias("l1"), "tn", "t1",
        F.coalesce("next", "after").alias("next"))
    return out.where(F.col("next").isNotNull() & (F.col("nl") >= min_leaf) & (F.col("tn") - F.col("nl") >= min_leaf))


def gini(ones: str, rows: str) -> str:
    """Rows times Gini impurity."""
    return f"(2e0 * CAST({ones} AS DOUBLE) * CAST({rows} - {ones} AS DOUBLE) / CAST({rows} AS DOUBLE))"


#: Fall of (rows times impurity) by a split, as text for both engines.
GAIN = f"({gini('t1', 'tn')} - {gini('l1', 'nl')} - {gini('(t1 - l1)', '(tn - nl)')})"


def grow_tree(df: DataFrame, defect_type: str, depth: int = TREE_DEPTH, min_leaf: int = TREE_MIN_LEAF) -> tuple[list[dict], list[str]]:
    """C-6: (splits, features) of the tree, found level by level from counts per (node, feature, value).

    A split is the boundary of the largest gain over all values of all features; ties go to the
    earlier feature and the smaller value.  Its threshold is the middle between the values on both
    sides.  Categoricals are ordered as text (null first) and their thresholds given in places
    of that order, without encoding any row."""
    params = [p for p in PARAMS if p in df.columns]
    names = CATS + params
    middle = exact_quantiles(df, params, 0.5)
    y = F.coalesce((F.col("defect_type") == defect_type).cast("int"), F.lit(0)).alias("y")
    rows = df.select(*CATS, *params, y, F.lit(1).alias("node"))
    splits: list[dict] = []
    root = None
    for level in range(depth):
        counts = value_counts(rows, names, middle)
        if root is None:
            counts = root = materialize(counts, "root-counts")
        best = F.min(F.struct((-F.expr(GAIN)).alias("loss"), "f", "num", "txt", "next", "tn"))
        found = split_candidates(counts, min_leaf).where(F.expr(GAIN) > MIN_GAIN).groupBy("node").agg(best.alias("b")).collect()
        here = []                                            # at most 2^level rows
        for r in found:
            b, name = r["b"], names[r["b"]["f"]]
            here.append({"node": r["node"], "feature": name, "num": b["num"], "txt": b["txt"], "gain": -b["loss"], "rows": b["tn"],
                         "next": b["next"]["txt"] if name in CATS else b["next"]["num"]})
        places = _places(root, names, [(s["feature"], v) for s in here if s["feature"] in CATS for v in (s["txt"], s["next"])])
        for s in here:
            sides = [places[s["feature"], v] for v in (s["txt"], s["next"])] if s["feature"] in CATS else [s["num"], s["next"]]
            s["threshold"] = (sides[0] + sides[1]) / 2
        splits += here
        node, kept = F.col("node"), F.lit(None).cast("int")
        for s in here:
            left = _left(s["feature"], s["num"], s["txt"], middle)
            kept = F.when(node == s["node"], F.when(left, F.lit(2 * s["node"])).otherwise(2 * s["node"] + 1)).otherwise(kept)
        if not here:
            break
        rows = rows.withColumn("node", kept).where("node is not null")
    return splits, names


def _places(root: DataFrame, names: list[str], values: list[tuple]) -> dict:
    """Place of categorical values among all values of their feature (null: -1)."""
    if not values:
        return {}
    asked = [F.count_if((F.col("f") == names.index(c)) & (F.col("txt") < F.lit(v))) for c, v in values]
    got = root.agg(*[a.alias(f"p{i}") for i, a in enumerate(asked)]).first()
    return {(c, v): -1.0 if v is None else float(got[i]) for i, (c, v) in enumerate(values)}


def decision_tree(df: DataFrame, defect_type: str, depth: int = TREE_DEPTH, min_leaf: int = TREE_MIN_LEAF):
    """C-6..C-8: shallow Gini tree for ``defect_type == t`` with exact thresholds; (splits, importances).

    Splits: feature, threshold (3 dp), importance (share of all gain, 4 dp) and in percent, the
    ``TOP_SPLITS`` largest.  Importances: share of gain per feature in percent."""
    found, names = grow_tree(df, defect_type, depth, min_leaf)
    spark = df.sparkSession
    nodes = spark.createDataFrame([(s["node"], s["feature"], float(s["threshold"]), float(s["gain"])) for s in found],
                                  "node int, feature string, t double, gain double")
    total = sum(s["gain"] for s in sorted(found, key=lambda s: s["node"]))
    share = f"(`gain` / {X.lit(total or 1.0)})"
    splits = nodes.select("node", "feature", X.spark(X.round_half_up("`t`", 3)).alias("threshold"),
                          X.spark(X.round_half_up(share, 4)).alias("importance"),
                          X.spark(X.round_half_up(f"{share} * 1e2", 1)).alias("importance_pct"))
    splits = splits.orderBy(F.desc("importance"), "node").limit(TOP_SPLITS).drop("node")
    sums = nodes.groupBy("feature").agg(F.sum("gain").alias("gain"))
    every = spark.createDataFrame([(c,) for c in names], "feature string").join(sums, "feature", "left").fillna(0.0, ["gain"])
    return splits, every.select("feature", X.spark(X.round_half_up(f"{share} * 1e2", 1)).alias("importance_pct"))


def top_evidence_for_type(patterns: DataFrame, evidence: DataFrame, defect_type: str, n: int = 4) -> DataFrame:
    """C-9: the type's strongest patterns with their evidence, by score (top ``n``)."""
    p = patterns.where(F.lower(F.col("defect_type")) == defect_type.lower()).select("pattern_id", "pattern_score", "rank")
    return (p.join(evidence, "pattern_id", "inner").orderBy(F.col("pattern_score").desc(), F.col("rank")).limit(n))
