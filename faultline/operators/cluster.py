"""Clustering of machine × shift × 7-day operating windows.

The feature table has one row per (window, machine, shift): its size follows time and
the machine / shift cardinalities, not the number of inspections.  It is built by one
distributed aggregate and checkpointed; scaling, PCA and K-means run on it with
``pyspark.ml``; DBSCAN works on a graph of grid cells, whose links are found box by box, with
components by star contraction — no pairs of points are listed and nothing is collected.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import formulas as X
from faultline.functions.components import components
from faultline.session import materialize, ship_package

NUM_FEATURES = ["defect_rate", "temperature", "pressure", "speed", "vibration", "humidity"]
# Constant parameter fills when a column is absent, cluster names.
ABSENT_FILL = {"temperature": 25.0, "pressure": 1.0, "speed": 100.0, "vibration": 0.5, "humidity": 50.0}
CLUSTER_NAMES = ["Stable Operation", "Elevated Defects", "High-Parameter Regime", "Anomalous Conditions", "Mixed"]
HOT, HOT_NAME = 1.5, "Hot & Defective"
COOL, COOL_NAME = 0.7, "Stable Operation"
WINDOW_DAYS = 7
MIN_ROWS = 5
PCA_MIN_ROWS = 3
K_RANGE = (3, 5)
RESTARTS = 10
SEED = 42
DBSCAN_EPS, DBSCAN_MIN_SAMPLES, DBSCAN_MIN_ROWS = 0.9, 5, 15


def window_features(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """M-1: (7-day epoch-anchored window, machine, shift) → units, defects, mean params,
    rows; groups with fewer than ``min_rows`` rows are left out (pass 1 for tables of a few rows)."""
    params = {p: (F.avg(p) if p in df.columns else F.lit(ABSENT_FILL[p])) for p in ABSENT_FILL}
    g = df.groupBy(F.window("timestamp", f"{WINDOW_DAYS} days").start.alias("window_start"),
                   "machine_id", "shift").agg(
        F.sum("units_inspected").alias("units"), F.sum("defect_count").alias("defects"),
        *[v.alias(p) for p, v in params.items()], F.count(F.lit(1)).alias("rows"))
    g = g.where(F.col("rows") >= min_rows)
    return g.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window"), "machine_id", "shift", "units", "defects",
        X.spark("CAST(`defects` AS DOUBLE) / CAST(greatest(`units`, 1) AS DOUBLE)").alias("defect_rate"),
        *ABSENT_FILL.keys(), "rows")


def standardize(feat: DataFrame, cols=NUM_FEATURES) -> DataFrame:
    """M-2: zero mean, unit *population* std per feature; constant features → 0.
    The 2 × 6 moments come back in one small job and enter the plan as literals."""
    st = feat.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = feat
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        out = out.withColumn(f"z_{c}", ((F.col(c) - F.lit(m)) / F.lit(s)) if s else F.lit(0.0))
    return out


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("pid", F.concat_ws("|", "window", "machine_id", "shift"))


def scaled_features(df: DataFrame, checkpoint: bool = True, min_rows: int = MIN_ROWS) -> DataFrame:
    """M-1 + M-2 + assembled vector, shared by K-means and DBSCAN (M-9)."""
    feat = window_features(df, min_rows)
    feat = materialize(feat, "features") if checkpoint else feat.cache()   # bounded table, read by every model
    z = _key(standardize(feat))
    return VectorAssembler(inputCols=[f"z_{c}" for c in NUM_FEATURES], outputCol="features").transform(z)


def pca_2d(z: DataFrame, cols=NUM_FEATURES):
    """M-3: two principal components (sign fixed: largest |loading| positive, the first of equal ones) and
    the explained-variance ratios.  Refuses tables of fewer than ``PCA_MIN_ROWS`` windows.

    One aggregate gives the covariances of the features, a matrix of a fixed size, whose eigenvectors
    enter the plan as literals; no row leaves the tasks."""
    zc = [f"z_{c}" for c in cols]
    pairs = [(i, j) for i in range(len(zc)) for j in range(i, len(zc))]
    got = z.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(zc[i], zc[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if got["n"] < PCA_MIN_ROWS:
        raise ValueError(f"projection needs at least {PCA_MIN_ROWS} windows")
    cov = np.zeros((len(zc), len(zc)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"]
    values, vectors = np.linalg.eigh(cov)
    out, total = z, float(values.sum()) or 1.0
    for k in (1, 2):
        v = vectors[:, -k]
        v = v * np.sign(v[np.argmax(np.round(np.abs(v), 9))])
        out = out.withColumn(f"pc{k}", sum(F.col(c) * F.lit(float(x)) for c, x in zip(zc, v, strict=True)))
    return out, [float(values[-k]) / total for k in (1, 2)]


#: Points of a block; two blocks at a time are compared.
SILHOUETTE_BLOCK = 2048


def silhouettes(points: DataFrame, pid: str, cluster: str, cols: list[str]) -> DataFrame:
    """M-5: ``pid, cluster, silhouette`` with Euclidean distances, exact: (b - a) / max(a, b) of the mean
    distance a to the point's own cluster and the least mean distance b to another one; 0 in a
    cluster of one.

    Points are dealt to blocks by a hash; a task step adds up one block's distances to another one
    by cluster, so what leaves it is a sum per point and cluster, never a pair."""
    d = len(cols)
    ship_package(points.sparkSession)
    rows = materialize(points.select(F.col(pid).alias("pid"), F.col(cluster).cast("string").alias("c"),
                                     F.array(*[F.col(x).cast("double") for x in cols]).alias("x")), "placed")
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    blocks = max(1, -(-rows.count() // SILHOUETTE_BLOCK))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("left", F.lit(True))
    right = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("left", F.lit(False))

    def sums(table: pa.Table) -> pa.Table:
        x = np.asarray(table["x"].combine_chunks().flatten()).reshape(-1, d)
        mine = np.asarray(table["left"].combine_chunks()).astype(bool)
        coded = table["c"].combine_chunks().dictionary_encode()
        code, names = np.asarray(coded.indices)[~mine], coded.dictionary
        a, b, ids = x[mine], x[~mine], table["pid"].combine_chunks().filter(pa.array(mine))
        found = np.zeros((len(a), len(names)))
        for lo in range(0, len(a), 256):
            dist = np.sqrt(((a[lo: lo + 256, None] - b) ** 2).sum(axis=2))
            for k in range(len(names)):
                found[lo: lo + 256, k] = dist[:, code == k].sum(axis=1)
        who, k = np.nonzero(np.isin(np.arange(len(names)), code) & np.ones((len(a), 1), bool))
        return pa.table({"pid": ids.take(pa.array(who)), "other": names.take(pa.array(k)), "s": found[who, k]})

    kind = dict(rows.dtypes)["pid"]
    cols_ = ["i", "j", "left", "pid", "c", "x"]
    part = left.select(*cols_).unionByName(right.select(*cols_)).groupBy("i", "j").applyInArrow(sums, f"pid {kind}, other string, s double")
    total = part.groupBy("pid", "other").agg(F.sum("s").alias("s")).join(F.broadcast(sizes.withColumnRenamed("c", "other")), "other")
    means = total.join(rows.select("pid", "c"), "pid").groupBy("pid", "c").agg(
        F.max(F.when(F.col("other") == F.col("c"), F.col("n"))).alias("n"),
        F.max(F.when((F.col("other") == F.col("c")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(F.col("other") != F.col("c"), F.col("s") / F.col("n"))).alias("b"))
    value = F.when((F.col("n") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return means.select("pid", F.col("c").alias("cluster"), F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def kmeans_sweep(z: DataFrame, k_range=K_RANGE, restarts: int = RESTARTS):
    """M-4 / M-5: for each k, the best of ``restarts`` seeded runs (lowest cost); k chosen
    by the mean exact silhouette (M-5)."""
    z = z.select("pid", "features", *[f"z_{c}" for c in NUM_FEATURES]).cache()      # bounded feature table, read by every iteration of every fit
    n = z.count()
    rows, best = [], None
    for k in range(k_range[0], k_range[1] + 1):
        if k >= n:
            continue
        # the restarts are independent: submit them concurrently (each fit is a chain of
        # small jobs, so one at a time leaves the cluster idle)
        with ThreadPoolExecutor(max_workers=restarts) as pool:
            models = list(pool.map(lambda r, k=k: KMeans(k=k, seed=SEED + r, featuresCol="features",
                                                            predictionCol="cluster", maxIter=50).fit(z),
                                   range(restarts)))
        model = min(models, key=lambda m: m.summary.trainingCost)
        sil = silhouettes(model.transform(z), "pid", "cluster", [f"z_{c}" for c in NUM_FEATURES]).agg(F.avg("silhouette")).first()[0]
        rows.append((k, float(sil), float(model.summary.trainingCost)))
        if best is None or sil > best[1]:
            best = (k, sil, model)
    z.unpersist()
    return rows, best


def cluster_profiles(points: DataFrame) -> DataFrame:
    """M-6: per cluster size, mean window rate %, difference / ratio vs the mean of all
    windows, two most frequent machines and shifts, parameter means, name."""
    gm = points.agg(F.avg("defect_rate")).scalar()
    g = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("records"), F.avg("defect_rate").alias("dr"),
                                      *[F.avg(p).alias(f"mean_{p}") for p in ABSENT_FILL])
    tops = []
    for c in ("machine_id", "shift"):
        w = Window.partitionBy("cluster").orderBy(F.col("n").desc(), F.col(c))
        t = (points.groupBy("cluster", c).agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("rk", F.row_number().over(w)).where("rk <= 2")
                   .groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(c)), ", ").alias(f"top_{c}")))
        tops.append(t)
    g = g.join(tops[0], "cluster", "left").join(tops[1], "cluster", "left").withColumn("gdr", gm)
    names = F.create_map(*[x for i, nme in enumerate(CLUSTER_NAMES) for x in (F.lit(i), F.lit(nme))])
    name = (F.when(F.col("dr") > HOT * F.col("gdr"), HOT_NAME).when(F.col("dr") < COOL * F.col("gdr"), COOL_NAME)
             .otherwise(names[F.col("cluster") % len(CLUSTER_NAMES)]))
    return g.select(
        "cluster", name.alias("name"), "records", F.round(F.col("dr") * 100, 2).alias("avg_defect_rate_pct"),
        F.round((F.col("dr") - F.col("gdr")) * 100, 2).alias("defect_rate_vs_global_pp"),
        F.when(F.col("gdr") > 0, F.round(F.col("dr") / F.col("gdr"), 2)).alias("defect_rate_vs_global_ratio"),
        F.col("top_machine_id").alias("machines"), F.col("top_shift").alias("shifts"),
        *[F.round(f"mean_{p}", 1).alias(p) for p in ABSENT_FILL])


def kmeans_clustering(df: DataFrame):
    """M-3..M-7: returns (sweep rows, profiles, labelled points, explained variance)."""
    return kmeans_on(*pca_2d(scaled_features(df)))


def cluster_both(df: DataFrame, eps: float = DBSCAN_EPS, min_samples: int = DBSCAN_MIN_SAMPLES):
    """M-9: K-means and DBSCAN over one shared feature table: (the four K-means results, DBSCAN
    labels with the same projection, or None below ``DBSCAN_MIN_ROWS`` windows)."""
    z, var = pca_2d(scaled_features(df))
    z = materialize(z, "projected")
    labels = dbscan(z, eps, min_samples) if z.limit(DBSCAN_MIN_ROWS).count() >= DBSCAN_MIN_ROWS else None
    return kmeans_on(z, var), labels


def kmeans_on(z: DataFrame, var: list[float]):
    """M-4..M-7 over scaled and projected windows."""
    z = materialize(z, "projected")
    sweep, best = kmeans_sweep(z)
    if best is None:
        return sweep, None, None, var
    pts = best[2].transform(z)
    points = pts.select("window", "machine_id", "shift", F.round("pc1", 3).alias("pc1"), F.round("pc2", 3).alias("pc2"),
                        "cluster", F.round(F.col("defect_rate") * 100, 2).alias("defect_rate_pct"),
                        "defect_rate", *ABSENT_FILL.keys())
    return sweep, cluster_profiles(points), points.drop("defect_rate", *ABSENT_FILL.keys()), var


# --------------------------------------------------------------------------- DBSCAN on a cell graph
#: A node of at most LEAF points is taken apart into its points, a larger one into cells of half the side, HALVINGS times.
LEAF, HALVINGS = 16, 8
#: Dimensions by which occupied cells are blocked when they look for cells in reach.
BLOCK_DIMS = 4


def _cell(level: int, side: float, d: int):
    """Name of a point's cell of side / 2^level."""
    return F.concat_ws(",", F.lit(str(level)), *[F.floor(F.col(f"x{i}") * (2 ** level / side)).cast("string") for i in range(d)])


def _nodes(pts: DataFrame, level: int, side: float, d: int) -> DataFrame:
    """Occupied cells of a level: key, up (the cell around it), n points, and the box around them:
    middle c and half width w (rounded up; 0 for a single point)."""
    up = _cell(level - 1, side, d) if level else F.lit("")
    boxes = pts.withColumn("key", _cell(level, side, d)).withColumn("up", up).groupBy("key").agg(
        F.first("up").alias("up"), F.count(F.lit(1)).alias("n"), *[F.min(f"x{i}").alias(f"lo{i}") for i in range(d)],
        *[F.max(f"x{i}").alias(f"hi{i}") for i in range(d)])
    middle = [F.when(F.col(f"lo{i}") < F.col(f"hi{i}"), (F.col(f"lo{i}") + F.col(f"hi{i}")) / 2).otherwise(F.col(f"lo{i}")).alias(f"c{i}")
              for i in range(d)]
    width = [F.when(F.col(f"lo{i}") < F.col(f"hi{i}"), (F.col(f"hi{i}") - F.col(f"lo{i}")) / 2
                    + (F.abs(f"lo{i}") + F.abs(f"hi{i}")) * 1e-15).otherwise(0.0).alias(f"w{i}") for i in range(d)]
    return boxes.select("key", "up", "n", *middle, *width)


def _single(pts: DataFrame, key, up, d: int) -> DataFrame:
    """Points as nodes of themselves."""
    return pts.select(key.alias("key"), up.alias("up"), F.lit(1).cast("bigint").alias("n"),
                      *[F.col(f"x{i}").alias(f"c{i}") for i in range(d)], *[F.lit(0.0).alias(f"w{i}") for i in range(d)])


def _summed(d: int, part):
    """Sum over dimensions of part(distance of the middles, sum of the half widths) squared.

    Lambdas keep the compiled join small enough for the JVM to compile it further."""
    apart = F.array(*[F.abs(F.col(f"a_c{i}") - F.col(f"b_c{i}")) for i in range(d)])
    width = F.array(*[F.col(f"a_w{i}") + F.col(f"b_w{i}") for i in range(d)])
    return F.aggregate(F.zip_with(apart, width, part), F.lit(0.0), lambda s, x: s + x * x)


def _gap(d: int):
    """Squared least distance of two boxes."""
    return _summed(d, lambda x, w: F.greatest(F.lit(0.0), x - w))


def _reach(d: int):
    """Squared largest distance of two boxes."""
    return _summed(d, lambda x, w: x + w)


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{name}_{c}") for c in nodes.columns if c != "up"])


def _near(left: DataFrame, right: DataFrame, side: float, eps: float, d: int) -> DataFrame:
    """Pairs of left nodes (points or cells) and right cells whose boxes come within ``eps``; only
    occupied cells of neighbouring blocks meet."""
    dims = range(min(BLOCK_DIMS, d))
    a, b = _side(left, "a"), _side(right, "b")
    for i in dims:                       # a cell is met in the block of its lowest corner, at most its side away
        low, high = F.col(f"a_c{i}") - F.col(f"a_w{i}"), F.col(f"a_c{i}") + F.col(f"a_w{i}")
        a = a.withColumn(f"block{i}", F.explode(F.sequence(F.floor((low - eps - side) / eps), F.floor((high + eps) / eps))))
        b = b.withColumn(f"block{i}", F.floor((F.col(f"b_c{i}") - F.col(f"b_w{i}")) / eps))
    keys = [f"block{i}" for i in dims]
    # the tables are small for the work on them: they are dealt to all cores whatever their size
    spark = left.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = a.repartition(tasks, *keys).join(b, keys)
    for i in range(d):                   # a dimension alone tells most pairs apart
        met = met.where(F.abs(F.col(f"a_c{i}") - F.col(f"b_c{i}")) <= F.col(f"a_w{i}") + F.col(f"b_w{i}") + eps * (1 + 1e-12))
    return met.drop(*keys)


def _within(pairs: DataFrame, left: DataFrame | None, right: DataFrame, side: float, eps: float, d: int) -> DataFrame:
    """``a, b, pairs``: for pairs of nodes (keys a, b), how many of their point pairs are found within
    ``eps``, without listing any: two boxes count as a whole once they lie within ``eps`` of each
    other, go once they do not, and are taken apart in between.

    ``left``: points of the left nodes (none if these are points already), ``right``: of the right."""
    rows = pairs.select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), "*")
    out = None
    for level in range(HALVINGS + 2):
        rows = rows.withColumn("sure", _reach(d) <= eps * eps)
        rows = materialize(rows.where(F.col("sure") | (_gap(d) <= eps * eps)), "box-pairs")
        sure = rows.where("sure").groupBy("a", "b").agg(F.sum(F.col("a_n") * F.col("b_n")).alias("pairs"))
        out = sure if out is None else out.unionByName(sure)
        rows = rows.where("not sure").drop("sure")
        if rows.isEmpty():
            break
        for name, pts in (("a", left), ("b", right)):
            if pts is None:
                continue
            n, own = F.col(f"{name}_n"), _cell(level, side, d)
            inner = _single(pts, own, own, d).withColumn("few", F.lit(True))
            if level < HALVINGS:
                inner = inner.unionByName(_nodes(pts, level + 1, side, d).withColumn("few", F.lit(False)))
            few = n <= LEAF if level < HALVINGS else F.lit(True)
            rows = rows.where(n == 1).unionByName(_apart(rows.where(n > 1), inner, name, few))
    return out.groupBy("a", "b").agg(F.sum("pairs").alias("pairs"))


def _apart(rows: DataFrame, parts: DataFrame, name: str, few) -> DataFrame:
    """One side of the pairs replaced by the nodes inside it: points where ``few``, else cells."""
    held = [c for c in rows.columns if c.startswith(f"{name}_")]
    inner = parts.select(F.col("up").alias("_up"), F.col("few").alias("_few"), *[F.col(c[2:]).alias(f"_{c}") for c in held])
    return rows.join(inner, (F.col(f"{name}_key") == F.col("_up")) & (F.col("_few") == few)).select(
        *[F.col(f"_{c}").alias(c) if c in held else F.col(c) for c in rows.columns])


def dbscan(z: DataFrame, eps: float = DBSCAN_EPS, min_samples: int = DBSCAN_MIN_SAMPLES,
           cols=NUM_FEATURES) -> DataFrame:
    """M-8: DBSCAN on the scaled features, Euclidean, self counted in ``min_samples``.

    1. cells of side eps / sqrt(d): points of one cell are within eps of each other, so all points of
       a cell of ``min_samples`` are core without a distance;
    2. the other points count their neighbours over the cells in reach, box by box (``_within``);
    3. clusters: components of the graph of cells with core points, two cells being linked if
       some core points of theirs are within eps, found in the same way;
    4. border points take the smallest label among the cells with a core point within eps; the rest
       is noise (−1), also a point with a null feature.  Clusters are numbered 0.. by their smallest
       point key.

    No table of point pairs is made: what is stored is linear in points and in pairs of occupied
    cells in reach of each other."""
    d = len(cols)
    side = eps / math.sqrt(d) * (1 - 1e-12)
    key = _cell(0, side, d)
    pts = z.select("pid", *[F.col(f"z_{c}").alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    pts = materialize(pts.withColumn("cell", key), "points")
    cells = materialize(_nodes(pts, 0, side, d), "cells")
    dense = cells.where(F.col("n") >= min_samples).select(F.col("key").alias("cell"))
    thin = pts.join(dense, "cell", "left_anti")
    around = _within(_near(_single(thin, F.col("pid"), F.col("cell"), d), cells, side, eps, d), None, pts, side, eps, d)
    found = around.groupBy("a").agg(F.sum("pairs").alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("pid"))
    core = materialize(pts.join(dense, "cell", "left_semi").unionByName(thin.join(found, "pid", "left_semi").select(*pts.columns)), "core")
    held = materialize(_nodes(core, 0, side, d), "core-cells")
    edges = _within(_near(held, held, side, eps, d).where("a_key < b_key"), core, core, side, eps, d).select("a", "b")
    linked = components(edges)                    # cells with another one in reach
    labels = core.join(linked, core["cell"] == linked["node"], "left").select("pid", "cell", F.coalesce("component", "cell").alias("c"))
    least = labels.groupBy("c").agg(F.min("pid").alias("label"))
    labels = materialize(labels.join(least, "c").select("pid", "cell", "label"), "labels")
    rest = pts.join(labels.select("pid"), "pid", "left_anti")
    border = _within(_near(_single(rest, F.col("pid"), F.col("cell"), d), held, side, eps, d), None, core, side, eps, d)
    border = border.join(labels.select("cell", "label").distinct(), F.col("b") == F.col("cell")).groupBy("a").agg(
        F.min("label").alias("label")).withColumnRenamed("a", "pid")
    labels = labels.select("pid", "label")
    all_labels = labels.unionByName(border)
    ids = all_labels.select("label").distinct().withColumn(
        "cluster", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))   # one row per cluster
    place = [c for c in ("pc1", "pc2") if c in z.columns]
    out = (z.select("pid", "window", "machine_id", "shift", "defect_rate", *place)
             .join(all_labels, "pid", "left").join(ids, "label", "left")
             .withColumn("cluster", F.coalesce("cluster", F.lit(-1))))
    return out.select("window", "machine_id", "shift", "cluster", *[F.round(c, 3).alias(c) for c in place],
                      F.round(F.col("defect_rate") * 100, 2).alias("defect_rate_pct"))


def dbscan_summary(labels: DataFrame, eps: float = DBSCAN_EPS) -> DataFrame:
    return labels.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
                      F.sum((F.col("cluster") == -1).cast("int")).alias("n_outliers"),
                      F.lit(eps).alias("eps"), F.count(F.lit(1)).alias("points"))
