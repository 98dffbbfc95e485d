"""DBSCAN (grid-blocked range join + contraction) equals a brute-force DBSCAN."""

import numpy as np

from faultline.operators import cluster as M
from faultline.sources.fixtures import inspections

from conftest import SF_MID


def brute_dbscan(X, eps, min_samples):
    n = len(X)
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= min_samples
    label = -np.ones(n, dtype=int)
    comp = 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        stack, label[i] = [i], comp
        while stack:
            j = stack.pop()
            for k in np.where(nb[j] & core)[0]:
                if label[k] < 0:
                    label[k] = comp
                    stack.append(k)
        comp += 1
    return core, label, nb


def test_dbscan_matches_brute_force(spark):
    z = M.scaled_features(inspections(spark, SF_MID).where("machine_id IN ('M01', 'M02')"))
    cols = [f"z_{c}" for c in M.NUM_FEATURES]
    pts = sorted(z.select("pid", *cols).collect(), key=lambda r: r["pid"])
    X = np.array([[r[c] for c in cols] for r in pts])
    core, label, nb = brute_dbscan(X, M.DBSCAN_EPS, M.DBSCAN_MIN_SAMPLES)
    got = {r["window"] + "|" + r["machine_id"] + "|" + r["shift"]: r["cluster"] for r in M.dbscan(z).collect()}
    pid = [r["pid"] for r in pts]
    # same partition of the core points into clusters
    mapping = {}
    for i in range(len(pts)):
        if core[i]:
            mapping.setdefault(label[i], set()).add(got[pid[i]])
    assert all(len(v) == 1 for v in mapping.values())
    assert len({next(iter(v)) for v in mapping.values()}) == len(mapping)
    # noise exactly where no core point is within eps
    for i in range(len(pts)):
        has_core = bool((nb[i] & core).any())
        assert (got[pid[i]] == -1) == (not has_core)


def test_long_chain_is_one_cluster(spark):
    cols = [f"z_{c}" for c in M.NUM_FEATURES]
    rows = [(f"{k * 37 % 240:03d}", "w", "m", "s", 0.0, 0.4 * k, *[0.0] * 5) for k in range(240)]
    z = spark.createDataFrame(rows, "pid string, window string, machine_id string, shift string, defect_rate double, "
                              + ", ".join(f"{c} double" for c in cols))
    assert [r["cluster"] for r in M.dbscan(z).select("cluster").distinct().collect()] == [0]


def _cloud(spark, rows):
    cols = [f"z_{c}" for c in M.NUM_FEATURES]
    return spark.createDataFrame([(f"{k:05d}", f"{k:05d}", "m", "s", 0.0, *map(float, r)) for k, r in enumerate(rows)],
                                 "pid string, window string, machine_id string, shift string, defect_rate double, "
                                 + ", ".join(f"{c} double" for c in cols))


def _same_clusters(got, X, eps, min_samples):
    core, label, nb = brute_dbscan(X, eps, min_samples)
    first = {}
    for i in np.flatnonzero(core):                       # clusters are numbered by their smallest point
        first.setdefault(label[i], len(first))
    for i in range(len(X)):
        near = [first[label[j]] for j in np.flatnonzero(nb[i] & core)]
        want = -1 if not near else first[label[i]] if core[i] else min(near)
        assert got[f"{i:05d}"] == want, i


def test_boxes_taken_apart_to_points(spark, monkeypatch):
    """Clouds around the reach of each other, with small leaves, so that boxes are halved again and again."""
    monkeypatch.setattr(M, "LEAF", 3)
    monkeypatch.setattr(M, "HALVINGS", 3)
    rng = np.random.default_rng(4)
    X = np.concatenate([rng.normal(c, 0.16, (45, 6)) for c in (0.0, 0.45, 1.6)] + [rng.uniform(-3, 3, (40, 6)), np.zeros((20, 6))])
    got = {r["window"]: r["cluster"] for r in M.dbscan(_cloud(spark, X)).collect()}
    _same_clusters(got, X, M.DBSCAN_EPS, M.DBSCAN_MIN_SAMPLES)


def test_what_is_stored_is_linear_in_points(spark, monkeypatch):
    """Half of all points in one cell, the others in as many cells at any size: the largest stored table
    grows with the points, not with their pairs."""
    def largest(n):
        rng = np.random.default_rng(7)
        far = rng.integers(0, 3, (n // 2, 6)) * 2.0 + rng.uniform(0, 0.1, (n // 2, 6))
        X = np.concatenate([rng.uniform(0.5, 0.6, (n // 2, 6)), far])
        held, real = [], M.materialize
        monkeypatch.setattr(M, "materialize", lambda df, name: held.append(real(df, name)) or held[-1])
        assert M.dbscan(_cloud(spark, X)).count() == n
        monkeypatch.setattr(M, "materialize", real)
        return max(t.count() for t in held)
    assert largest(1600) <= 5 * largest(400)
