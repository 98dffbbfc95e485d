"""Registered root-cause queries and their SQL oracles."""

from __future__ import annotations

from faultline.functions import formulas as X
from faultline.operators import investigate as C
from faultline.plans.catalog import register
from faultline.sources.fixtures import inspections, with_views

Q = X.to_duckdb
TYPE = "STANDARD"        # the defect type investigated in the fixture queries
PARAMS = ["temperature", "pressure", "speed", "vibration", "humidity"]


@register("c01_target_baseline", with_views(f"""
SELECT '{TYPE}' AS defect_type, CAST(target_units AS BIGINT) AS target_units,
       CAST(target_defects AS BIGINT) AS target_defects,
       {Q(X.rate_pct('"target_defects"', '"target_units"'))} AS target_rate,
       {Q(X.round_half_up(X.safe_div('"d" * 1e2', '"u"', '0e0'), 2))} AS baseline_rate
FROM (SELECT sum(CASE WHEN defect_type = '{TYPE}' THEN units_inspected ELSE 0 END) AS target_units,
             sum(CASE WHEN defect_type = '{TYPE}' THEN defect_count ELSE 0 END) AS target_defects,
             sum(units_inspected) AS u, sum(defect_count) AS d FROM inspections)"""))
def c01(spark, sf):
    return C.target_baseline(inspections(spark, sf), TYPE)


def _contribution_sql(reference_cells: bool = False) -> str:
    q = ", ".join(f"quantile_cont({p}, 0.9) AS q_{p}" for p in PARAMS)
    arms = [f"SELECT '{c}' AS factor_col, CAST({c} AS VARCHAR) AS factor_value, defect_type, units_inspected, "
            f"defect_count FROM inspections" for c in C.CATS]
    for p in PARAMS:
        txt = Q(X.g_text(X.sig6(f'"q_{p}"')))
        arms.append(f"SELECT '{p}_bucket', CASE WHEN coalesce({p} > q_{p}, false) THEN concat('>', {txt}) "
                    f"ELSE concat('<=', {txt}) END, defect_type, units_inspected, defect_count FROM inspections, q")
    fourth = '"tot_out"' if reference_cells else '("tot_out" - "def_out")'
    x, t, p = X.chi2_pvalue_sql_steps('"def_in"', '("tot_in" - "def_in")', '"def_out"', fourth)
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(C.CATS + [f"{p}_bucket" for p in PARAMS]))
    label = " ".join(f"WHEN '{c}' THEN '{C.factor_label(c)}'" for c in C.CATS + [f"{p}_bucket" for p in PARAMS])
    return with_views(f"""
WITH q AS (SELECT {q} FROM inspections),
long AS ({" UNION ALL ".join(arms)}),
tot AS (SELECT sum(CASE WHEN defect_type = '{TYPE}' THEN units_inspected ELSE 0 END) AS target_units,
               sum(CASE WHEN defect_type = '{TYPE}' THEN defect_count ELSE 0 END) AS target_defects,
               {Q(X.safe_div('sum(units_inspected) * 0e0 + sum(defect_count)', 'sum(units_inspected)', '0e0'))} AS global_rate
        FROM inspections),
g AS (SELECT factor_col, factor_value, count(*) AS n,
             sum(CASE WHEN defect_type = '{TYPE}' THEN units_inspected ELSE 0 END) AS tot_in,
             sum(CASE WHEN defect_type = '{TYPE}' THEN defect_count ELSE 0 END) AS def_in
      FROM long GROUP BY factor_col, factor_value),
g1 AS (SELECT g.*, count(*) OVER (PARTITION BY factor_col) AS levels, tot.* FROM g, tot),
g2 AS (SELECT *, target_defects - def_in AS def_out, target_units - tot_in AS tot_out FROM g1
       WHERE n >= {C.MIN_ROWS}),
g3 AS (SELECT *, {Q(X.safe_div('"def_in"', '"tot_in"', '0e0'))} AS r_in,
              {Q(X.safe_div('"def_out"', '"tot_out"', '"global_rate"'))} AS r_out FROM g2),
g4 AS (SELECT *, CASE WHEN r_out > 0 THEN r_in / r_out END AS lift_raw FROM g3),
g5 AS (SELECT *, {Q(x)} AS _chi_x FROM g4 WHERE lift_raw IS NOT NULL AND lift_raw >= 1.0),
g6 AS (SELECT *, {Q(t)} AS _chi_t FROM g5),
g7 AS (SELECT *, {Q(p)} AS p_raw FROM g6),
g8 AS (SELECT *, {Q(X.round_half_up('"lift_raw"', 2))} AS lift, {Q(X.round_half_up('"p_raw"', 4))} AS p_value
       FROM g7 WHERE p_raw IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY lift DESC, p_value ASC, CASE factor_col {order} END, factor_value) AS rank
      FROM g8)
SELECT rank, CASE factor_col {label} END AS factor, factor_value,
       {Q(X.association('"lift_raw"', '"p_raw"'))} AS association,
       {Q(X.round_half_up('"r_in" * 1e2', 2))} AS defect_rate_in,
       {Q(X.round_half_up('"r_out" * 1e2', 2))} AS baseline_rate, lift, n AS sample_size, p_value,
       {Q(X.p_display('"p_raw"'))} AS p_display
FROM r WHERE rank <= {C.TOP_FACTORS}""")


@register("c02_contribution_ranking", _contribution_sql())
def c02(spark, sf):
    return C.contribution(inspections(spark, sf), TYPE)


@register("c02b_contribution_reference_cells", _contribution_sql(reference_cells=True))
def c02b(spark, sf):
    return C.contribution(inspections(spark, sf), TYPE, reference_cells=True)


def _ranked(mi: str) -> str:
    return f"""SELECT feature, {Q(X.round_half_up('greatest("mi", 0e0)', 6))} AS mutual_information,
       row_number() OVER (ORDER BY {Q(X.round_half_up('greatest("mi", 0e0)', 6))} DESC, feature) AS rank FROM {mi}"""


def _mi_sql() -> str:
    ps = [i / C.MI_BINS for i in range(1, C.MI_BINS)]
    edges = ", ".join(f"list_distinct([{', '.join(f'quantile_cont({p}, {x})' for x in ps)}]) AS e_{p}" for p in PARAMS)
    arms = [f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS bin, y FROM base" for c in C.CATS]
    arms += [f"SELECT '{p}', CASE WHEN {p} IS NULL THEN '-1' ELSE CAST(len(list_filter(e_{p}, lambda e: {p} > e)) AS VARCHAR) END, y FROM base, edges"
             for p in PARAMS]
    term = ('(CASE WHEN nx1 > 0 THEN CAST(nx1 AS DOUBLE) / CAST("N" AS DOUBLE) * ln(CAST(nx1 AS DOUBLE) * CAST("N" AS DOUBLE) / (CAST(nx AS DOUBLE) * CAST("N1" AS DOUBLE))) ELSE 0e0 END'
            ' + CASE WHEN nx0 > 0 THEN CAST(nx0 AS DOUBLE) / CAST("N" AS DOUBLE) * ln(CAST(nx0 AS DOUBLE) * CAST("N" AS DOUBLE) / (CAST(nx AS DOUBLE) * CAST("N" - "N1" AS DOUBLE))) ELSE 0e0 END)')
    return with_views(f"""
WITH base AS (SELECT *, CASE WHEN defect_type = '{TYPE}' THEN 1 ELSE 0 END AS y FROM inspections),
edges AS (SELECT {edges} FROM inspections),
long AS ({" UNION ALL ".join(arms)}),
tot AS (SELECT count(*) AS "N", sum(y) AS "N1" FROM base),
cells AS (SELECT feature, bin, count(*) AS nx, sum(y) AS nx1, count(*) - sum(y) AS nx0 FROM long GROUP BY feature, bin),
mi AS (SELECT feature, sum({term}) AS mi FROM cells, tot GROUP BY feature)
{_ranked("mi")}""")


def _knn_sql() -> str:
    """Distances by laterally looking at the k values of the class on each side; counts by range joins of values."""
    codes = [f"SELECT '{c}' AS feature, y, CASE WHEN {c} IS NULL THEN -1e0 ELSE CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS DOUBLE) END AS v FROM base"
             for c in C.CATS]
    nums = [f"SELECT '{p}', y, CAST(coalesce({p}, (SELECT quantile_cont({p}, 0.5) FROM inspections), 0) AS DOUBLE) FROM base" for p in PARAMS]
    k = C.MI_NEIGHBOURS
    beside = ", ".join(f"{f}({{'d': v, 'n': n}}, {i}) OVER o" for f in ("lag", "lead") for i in range(1, k + 1))
    return with_views(f"""
WITH base AS (SELECT *, CASE WHEN defect_type = '{TYPE}' THEN 1 ELSE 0 END AS y FROM inspections),
long AS ({" UNION ALL ".join(codes + nums)}),
size AS (SELECT y, count(*) AS nc, least({k}, count(*) - 1) AS k FROM base GROUP BY y HAVING count(*) > 1),
cell AS (SELECT feature, y, v, nc, k, count(*) AS n FROM long JOIN size USING (y) GROUP BY ALL),
side AS (SELECT *, [{beside}] AS b FROM cell WINDOW o AS (PARTITION BY feature, y ORDER BY v)),
dist AS (SELECT feature, y, v, n, nc, k, unnest(list_sort(list_transform(list_filter(b, lambda x: x IS NOT NULL), lambda x: {{'d': abs(x.d - v), 'n': x.n}}))) AS x FROM side
         UNION ALL SELECT feature, y, v, n, nc, k, {{'d': 0e0, 'n': n - 1}} FROM side),
cum AS (SELECT *, sum(x.n) OVER (PARTITION BY feature, y, v ORDER BY x.d, x.n ROWS UNBOUNDED PRECEDING) AS s FROM dist),
radius AS (SELECT feature, y, v, n, nc, k, min(x.d) AS r FROM cum WHERE s >= k GROUP BY ALL),
val AS (SELECT feature, v, sum(n) AS n FROM cell GROUP BY ALL),
upto AS (SELECT feature, v AS x, sum(n) OVER (PARTITION BY feature ORDER BY v) AS c, sum(n) OVER (PARTITION BY feature ORDER BY v) - n AS c0 FROM val),
m AS (SELECT t.feature, y, t.v, t.n, nc, k, CAST(CASE WHEN r = 0 THEN own.c - own.c0 ELSE hi.c - coalesce(lo.c, 0) END AS BIGINT) AS m
      FROM (SELECT *, v + r AS up, v - r AS low FROM radius) t JOIN upto own ON own.feature = t.feature AND own.x = t.v
      ASOF LEFT JOIN upto hi ON hi.feature = t.feature AND t.up > hi.x
      ASOF LEFT JOIN upto lo ON lo.feature = t.feature AND t.low >= lo.x),
parts AS (SELECT feature, CAST(sum(n) AS BIGINT) AS "N", sum(CAST(n AS DOUBLE) * ({C.digamma('k')} - {C.digamma('nc')} - {C.digamma('m')})) AS s FROM m GROUP BY feature),
mi AS (SELECT feature, {C.digamma('"N"')} + s / "N" AS mi FROM parts)
{_ranked("mi")}""")


@register("c05_mutual_information", _mi_sql())
def c05(spark, sf):
    return C.mutual_information(inspections(spark, sf), TYPE)


@register("c05b_knn_mutual_information", _knn_sql())
def c05b(spark, sf):
    return C.knn_mutual_information(inspections(spark, sf), TYPE)


@register("c04_feature_matrix", with_views(f"""
SELECT CAST(dense_rank() OVER (ORDER BY machine_id) - 1 AS DOUBLE) AS machine_id_idx,
       CAST(dense_rank() OVER (ORDER BY shift) - 1 AS DOUBLE) AS shift_idx,
       CAST(dense_rank() OVER (ORDER BY batch_id) - 1 AS DOUBLE) AS batch_id_idx,
       CAST(temperature AS DOUBLE) AS temperature_imp,
       CASE WHEN defect_type = '{TYPE}' THEN 1e0 ELSE 0e0 END AS label
FROM inspections"""))
def c04(spark, sf):
    feats, _ = C.feature_frame(inspections(spark, sf), TYPE)
    return feats.select("machine_id_idx", "shift_idx", "batch_id_idx", "temperature_imp", "label")


def _tree_sql(result: str) -> str:
    """The tree level by level over a long table of all (row, feature, value)."""
    names = C.CATS + PARAMS
    codes = ", ".join(f"CASE WHEN {c} IS NULL THEN -1e0 ELSE CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS DOUBLE) END AS f{i}"
                      for i, c in enumerate(C.CATS))
    nums = ", ".join(f"CAST(coalesce({p}, (SELECT quantile_cont({p}, 0.5) FROM inspections), 0) AS DOUBLE) AS f{len(C.CATS) + i}"
                     for i, p in enumerate(PARAMS))
    long = " UNION ALL ".join(f"SELECT rid, y, {i} AS f, f{i} AS v FROM x" for i in range(len(names)))
    sql = f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid, CASE WHEN defect_type = '{TYPE}' THEN 1 ELSE 0 END AS y, {codes}, {nums} FROM inspections),
long AS MATERIALIZED ({long}),
n0 AS (SELECT rid, 1 AS node FROM x)"""
    for k in range(C.TREE_DEPTH):
        sql += f""",
c{k} AS (SELECT node, f, v, count(*) AS n, sum(y) AS n1 FROM long JOIN n{k} USING (rid) GROUP BY ALL),
w{k} AS (SELECT node, f, v, lead(v) OVER o AS nv, CAST(sum(n) OVER o AS BIGINT) AS nl, CAST(sum(n1) OVER o AS BIGINT) AS l1,
                CAST(sum(n) OVER a AS BIGINT) AS tn, CAST(sum(n1) OVER a AS BIGINT) AS t1
         FROM c{k} WINDOW o AS (PARTITION BY node, f ORDER BY v), a AS (PARTITION BY node, f)),
g{k} AS (SELECT *, {C.GAIN} AS gain FROM w{k} WHERE nv IS NOT NULL AND nl >= {C.TREE_MIN_LEAF} AND tn - nl >= {C.TREE_MIN_LEAF}),
b{k} AS MATERIALIZED (SELECT * FROM g{k} WHERE gain > {C.MIN_GAIN} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1),
n{k + 1} AS MATERIALIZED (SELECT rid, 2 * node + CASE WHEN long.v <= b{k}.v THEN 0 ELSE 1 END AS node
            FROM n{k} JOIN b{k} USING (node) JOIN long USING (rid, f))"""
    every = " UNION ALL ".join(f"SELECT node, f, (v + nv) / 2 AS t, gain FROM b{k}" for k in range(C.TREE_DEPTH))
    label = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(names))
    share = '("gain" / (SELECT sum("gain" ORDER BY node) FROM s))'
    return with_views(sql + f""",
s AS (SELECT *, CASE f {label} END AS feature FROM ({every}))
""" + result.replace("$share", share))


@register("c07_tree_splits", _tree_sql(f"""SELECT feature, {Q(X.round_half_up('"t"', 3))} AS threshold, {Q(X.round_half_up('$share', 4))} AS importance,
       {Q(X.round_half_up('$share * 1e2', 1))} AS importance_pct FROM s ORDER BY importance DESC, node LIMIT {C.TOP_SPLITS}"""))
def c07(spark, sf):
    splits, _ = C.decision_tree(inspections(spark, sf), TYPE)
    return splits


@register("c08_tree_importances", _tree_sql(f"""SELECT feature, {Q(X.round_half_up('$share * 1e2', 1))} AS importance_pct
FROM (SELECT feature, sum(coalesce(gain, 0)) AS gain FROM (VALUES {", ".join(f"('{c}')" for c in C.CATS + PARAMS)}) e(feature) LEFT JOIN s USING (feature) GROUP BY feature)"""))
def c08(spark, sf):
    _, imps = C.decision_tree(inspections(spark, sf), TYPE)
    return imps
