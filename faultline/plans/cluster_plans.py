"""Registered clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import formulas as X
from faultline.operators import cluster as M
from faultline.plans.catalog import register
from faultline.sources.fixtures import inspections, with_views

Q = X.to_duckdb
P = list(M.ABSENT_FILL)

FEATURES_SQL = f"""feat AS (
  SELECT strftime(time_bucket(INTERVAL 7 DAY, "timestamp", TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS "window",
         machine_id, shift, CAST(sum(units_inspected) AS BIGINT) AS units, CAST(sum(defect_count) AS BIGINT) AS defects,
         CAST(sum(defect_count) AS DOUBLE) / CAST(greatest(sum(units_inspected), 1) AS DOUBLE) AS defect_rate,
         {", ".join(f"avg({p}) AS {p}" for p in P)}, count(*) AS rows
  FROM inspections GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""


@register("m01_window_features", with_views(
    f"WITH {FEATURES_SQL}\nSELECT \"window\", machine_id, shift, units, defects, defect_rate, "
    + ", ".join(f"{Q(X.round_half_up(p, 4))} AS {p}" for p in P) + ", rows FROM feat"))
def m01(spark, sf):
    f = M.window_features(inspections(spark, sf))
    return f.select("window", "machine_id", "shift", "units", "defects", "defect_rate",
                    *[X.spark(X.round_half_up(f"`{p}`", 4)).alias(p) for p in P], "rows")


@register("m02_standardized_features", with_views(
    f"WITH {FEATURES_SQL}\nSELECT \"window\", machine_id, shift, "
    + ", ".join(f"{Q(X.round_half_up(f'CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0e0 END', 4))} AS z_{c}"
                for c in M.NUM_FEATURES) + " FROM feat"))
def m02(spark, sf):
    z = M.standardize(M.window_features(inspections(spark, sf)))
    return z.select("window", "machine_id", "shift",
                    *[X.spark(X.round_half_up(f"`z_{c}`", 4)).alias(f"z_{c}") for c in M.NUM_FEATURES])


Z_SQL = "z AS (SELECT concat_ws('|', \"window\", machine_id, shift) AS pid, \"window\", machine_id, shift, defect_rate, " + ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0e0 END AS z_{c}"
    for c in M.NUM_FEATURES) + " FROM feat)"
D = len(M.NUM_FEATURES)
#: Pairs of dimensions that a sweep of rotations goes through.
TURNS = [(p, q) for p in range(D) for q in range(p + 1, D)]


def _turned(m: str, columns: bool) -> str:
    """Matrix ``m`` (a list, row by row) with the columns (or rows) p and q rotated."""
    at = (lambda i, j: f"{m}[({i}) * {D} + ({j}) + 1]")
    row, col = f"(e // {D})", f"(e % {D})"
    this = col if columns else row
    p, q = (at(row, "p"), at(row, "q")) if columns else (at("p", col), at("q", col))
    return (f"list_transform(range({D * D}), lambda e: CASE {this} WHEN p THEN c * {p} - s * {q} "
            f"WHEN q THEN s * {p} + c * {q} ELSE {m}[e + 1] END)")


#: Eigenvectors of the covariances by Jacobi rotations, as a recursive fold over a list of 36 numbers.
PCA_SQL = f"""{FEATURES_SQL},
{Z_SQL.rstrip()},
cov AS (SELECT [{", ".join(f"covar_pop(z_{a}, z_{b})" for a in M.NUM_FEATURES for b in M.NUM_FEATURES)}] AS a FROM z),
turn(k, p, q) AS (VALUES {", ".join(f"({k}, {p}, {q})" for k, (p, q) in enumerate(TURNS))}),
jac AS (SELECT 0 AS step, a, [{", ".join(f"CAST({int(i == j)} AS DOUBLE)" for i in range(D) for j in range(D))}] AS v FROM cov
  UNION ALL
  SELECT step + 1, {_turned("b", False)}, w FROM (
    SELECT step, p, q, c, s, {_turned("a", True)} AS b, {_turned("v", True)} AS w FROM (
      SELECT *, 1e0 / sqrt(1e0 + t * t) AS c, t / sqrt(1e0 + t * t) AS s FROM (
        SELECT step, a, v, p, q, CASE WHEN abs(a[p * {D} + q + 1]) < 1e-300 THEN 0e0
               ELSE CASE WHEN tau >= 0 THEN 1e0 ELSE -1e0 END / (abs(tau) + sqrt(1e0 + tau * tau)) END AS t
        FROM (SELECT *, CASE WHEN abs(a[p * {D} + q + 1]) < 1e-300 THEN 0e0
                        ELSE (a[q * {D} + q + 1] - a[p * {D} + p + 1]) / (2e0 * a[p * {D} + q + 1]) END AS tau
              FROM jac JOIN turn ON turn.k = jac.step % {len(TURNS)} WHERE step < {10 * len(TURNS)}))))),
last AS (SELECT * FROM jac WHERE step = {10 * len(TURNS)}),
eig AS (SELECT k, a[k * {D} + k + 1] AS val, list_transform(range({D}), lambda i: v[i * {D} + k + 1]) AS vec
        FROM (SELECT a, v, unnest(range({D})) AS k FROM last)),
ranked AS (SELECT row_number() OVER (ORDER BY val DESC) AS r, val / sum(val) OVER () AS share, vec FROM eig),
signed AS (SELECT r, share, list_transform(vec, lambda x: x * sign(vec[list_position(list_transform(vec, lambda y: round(abs(y), 9)),
                  list_max(list_transform(vec, lambda y: round(abs(y), 9))))])) AS vec FROM ranked WHERE r <= 2),
pc AS (SELECT z.*, {", ".join(f"{' + '.join(f'z_{c} * v{r}.vec[{i + 1}]' for i, c in enumerate(M.NUM_FEATURES))} AS pc{r}, v{r}.share AS share{r}" for r in (1, 2))}
       FROM z, (SELECT * FROM signed WHERE r = 1) v1, (SELECT * FROM signed WHERE r = 2) v2)"""


def _recursive(sql: str) -> str:
    return with_views(sql).replace("WITH ", "WITH RECURSIVE ", 1)


@register("m03_pca_projection", _recursive(f"""WITH {PCA_SQL}
SELECT "window", machine_id, shift, {", ".join(f"{Q(X.round_half_up(f'pc{r}', 3))} AS pc{r}" for r in (1, 2))},
       {", ".join(f"{Q(X.round_half_up(f'share{r} * 1e2', 1))} AS pc{r}_variance_pct" for r in (1, 2))} FROM pc"""))
def m03(spark, sf):
    z, var = M.pca_2d(M.scaled_features(inspections(spark, sf)))
    return z.select("window", "machine_id", "shift", *[X.spark(X.round_half_up(f"`pc{r}`", 3)).alias(f"pc{r}") for r in (1, 2)],
                    *[X.spark(X.round_half_up(f"{X.lit(var[r - 1])} * 1e2", 1)).alias(f"pc{r}_variance_pct") for r in (1, 2)])


@register("m05_silhouette_of_machines", with_views(f"""WITH {FEATURES_SQL},
{Z_SQL.rstrip()},
pair AS (SELECT x.pid, x.machine_id AS c, y.machine_id AS o, count(*) FILTER (x.pid <> y.pid) AS n,
                sum(sqrt({" + ".join(f"(x.z_{c} - y.z_{c}) * (x.z_{c} - y.z_{c})" for c in M.NUM_FEATURES)})) AS s
         FROM z x, z y GROUP BY ALL),
ab AS (SELECT pid, c, max(CASE WHEN o = c THEN n END) AS n, max(CASE WHEN o = c AND n > 0 THEN s / n END) AS a,
              min(CASE WHEN o <> c THEN s / n END) AS b FROM pair GROUP BY ALL),
v AS (SELECT c, coalesce(CASE WHEN n > 0 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) END, 0e0) AS v FROM ab)
SELECT c AS machine_id, count(*) AS windows, {Q(X.round_half_up("avg(v)", 6))} AS silhouette FROM v GROUP BY c"""))
def m05(spark, sf):
    z = M.scaled_features(inspections(spark, sf))
    s = M.silhouettes(z, "pid", "machine_id", [f"z_{c}" for c in M.NUM_FEATURES])
    return s.groupBy(F.col("cluster").alias("machine_id")).agg(
        F.count(F.lit(1)).alias("windows"), X.spark(X.round_half_up("avg(silhouette)", 6)).alias("silhouette"))


@register("m04_kmeans_sweep")
def m04(spark, sf):
    sweep, best = M.kmeans_sweep(M.scaled_features(inspections(spark, sf)))
    return spark.createDataFrame([(k, round(s, 3), c, best is not None and k == best[0]) for k, s, c in sweep],
                                 "k int, silhouette double, cost double, chosen boolean")


@register("m06_cluster_profiles")
def m06(spark, sf):
    _, profiles, _, _ = M.kmeans_clustering(inspections(spark, sf))
    return profiles


@register("m07_cluster_points")
def m07(spark, sf):
    _, _, points, _ = M.kmeans_clustering(inspections(spark, sf))
    return points


#: Clusters by reachability over core points, as a recursive walk from each to all others.
DBSCAN_SQL = f"""{FEATURES_SQL},
{Z_SQL},
near AS MATERIALIZED (SELECT x.pid AS a, y.pid AS b FROM z x, z y WHERE {" + ".join(f"pow(x.z_{c} - y.z_{c}, 2)" for c in M.NUM_FEATURES)} <= {M.DBSCAN_EPS ** 2}),
core AS MATERIALIZED (SELECT a AS pid FROM near GROUP BY a HAVING count(*) >= {M.DBSCAN_MIN_SAMPLES}),
step AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN (SELECT pid AS a FROM core) USING (a) SEMI JOIN (SELECT pid AS b FROM core) USING (b)),
walk AS (SELECT pid AS a, pid AS b FROM core UNION SELECT walk.a, step.b FROM walk JOIN step ON walk.b = step.a),
label AS (SELECT a AS pid, min(b) AS label FROM walk GROUP BY a),
every AS (SELECT * FROM label UNION ALL SELECT a, min(label) FROM near JOIN label ON b = pid ANTI JOIN (SELECT pid AS a FROM core) USING (a) GROUP BY a),
number AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT label FROM label)),
db AS (SELECT "window", machine_id, shift, coalesce(cluster, -1) AS cluster, defect_rate
       FROM z LEFT JOIN every USING (pid) LEFT JOIN number USING (label))"""


@register("m08_dbscan_labels", _recursive(f"WITH {DBSCAN_SQL}\nSELECT \"window\", machine_id, shift, cluster, round(defect_rate * 100, 2) AS defect_rate_pct FROM db"))
def m08(spark, sf):
    return M.dbscan(M.scaled_features(inspections(spark, sf)))


@register("m08b_dbscan_summary", _recursive(f"""WITH {DBSCAN_SQL}
SELECT count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS n_clusters, CAST(count(*) FILTER (cluster = -1) AS BIGINT) AS n_outliers,
       {M.DBSCAN_EPS}e0 AS eps, count(*) AS points FROM db"""))
def m08b(spark, sf):
    return M.dbscan_summary(M.dbscan(M.scaled_features(inspections(spark, sf))))


@register("m09_shared_features", _recursive(f"""WITH {PCA_SQL},
{DBSCAN_SQL.split("near AS", 1)[1].join(["near AS", ""])}
SELECT db."window", db.machine_id, db.shift, db.cluster, round(db.defect_rate * 100, 2) AS defect_rate_pct,
       {", ".join(f"{Q(X.round_half_up(f'pc{r}', 3))} AS pc{r}" for r in (1, 2))}
FROM db JOIN pc ON db."window" = pc."window" AND db.machine_id = pc.machine_id AND db.shift = pc.shift"""))
def m09(spark, sf):
    """DBSCAN's labels on the projection that K-means has too (``cluster_both``'s shared table)."""
    z, _ = M.pca_2d(M.scaled_features(inspections(spark, sf)))
    z = z.select("*").withColumn("pc1", X.spark(X.round_half_up("`pc1`", 3))).withColumn("pc2", X.spark(X.round_half_up("`pc2`", 3)))
    return M.dbscan(z)
