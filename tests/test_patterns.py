"""Planted-effect recovery and slice invariants for the pattern miner."""

from pyspark.sql import functions as F

from faultline.operators import findings as R
from faultline.operators import patterns as P


def planted(spark, n=5000):
    """Seeded Spark job: 5 machines, 3 shifts, 10 batches, constant sensors, 1% base
    rate, machine M04 on shift B at 9%."""
    h = lambda salt: (F.abs(F.xxhash64(F.col("id"), F.lit(salt))) % 10_000) / 10_000.0
    df = spark.range(n).select(
        F.concat(F.lit("INS-"), F.col("id").cast("string")).alias("inspection_id"),
        F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 90 AS INT))").alias("timestamp"),
        F.concat(F.lit("M0"), (F.col("id") % 5 + 1).cast("string")).alias("machine_id"),
        F.concat(F.lit("B"), (F.col("id") % 10 + 1).cast("string")).alias("batch_id"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("id") % 3 + 1).cast("int")).alias("shift"),
        F.lit("Surface").alias("defect_type"), F.lit(100).cast("bigint").alias("units_inspected"), F.col("id"))
    hot = (F.col("machine_id") == "M04") & (F.col("shift") == "B")
    rate = F.when(hot, 0.09).otherwise(0.01)
    d = F.floor(rate * 100 + h(1) * 2 - 1).cast("bigint")
    return df.withColumn("defect_count", F.greatest(F.lit(0).cast("bigint"), d)).select(
        "*", *[F.lit(v).alias(p) for p, v in (("temperature", 70.0), ("pressure", 4.2), ("speed", 120.0),
                                               ("vibration", 0.45), ("humidity", 55.0))]).drop("id")


def test_planted_pair_is_the_top_pattern(spark):
    pats = P.patterns(planted(spark)).orderBy("rank").collect()
    assert pats, "no pattern found"
    top = pats[0]
    assert top["description"] == "Machine M04 + Shift B"
    assert top["lift"] > 3
    assert not any(("Temperature" in p["description"]) or ("Speed" in p["description"]) for p in pats)
    assert all(0 <= p["pattern_score"] <= 100 for p in pats)


def test_slice_plus_complement_is_total(spark):
    df = planted(spark)
    tot = df.agg(F.sum("units_inspected"), F.sum("defect_count")).first()
    for r in P.patterns(df).select("units_inspected", "u_out", "defective_units", "d_out").collect():
        assert r["units_inspected"] + r["u_out"] == tot[0]
        assert r["defective_units"] + r["d_out"] == tot[1]


def test_recommendations_are_capped_and_not_causal(spark):
    pats = P.patterns(planted(spark))
    recs = R.recommendations(pats)
    assert recs.count() <= 25
    audit = {r["source"]: r["caused_mentions"] for r in
             R.causal_language_audit(recommendations=recs, evidence=R.evidence(pats)).collect()}
    assert all(v == 0 for v in audit.values())


def test_four_factors_are_mined_and_pruned_by_support(spark):
    """A planted four-factor effect: counts of all its qualifying slices against plain counting."""
    import itertools
    import random

    from faultline.operators import patterns as P
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        m, s, b, hot = rng.choice(["M1", "M2"]), rng.choice("AB"), rng.choice(["B1", "B2"]), rng.random() < 0.09
        bad = m == "M1" and s == "A" and b == "B1" and hot
        rows.append((f"i{i}", f"2026-01-{1 + i % 28:02d}", m, s, b, "t", 6 if bad else rng.randrange(2), 10, 90.0 + rng.random() if hot else 10.0 + rng.random()))
    df = spark.createDataFrame(rows, "inspection_id string, timestamp string, machine_id string, shift string, batch_id string, "
                                     "defect_type string, defect_count long, units_inspected long, temperature double").selectExpr(
        "* except (timestamp)", "CAST(timestamp AS timestamp_ntz) AS timestamp")
    space = P.mining_space(df, 4)
    got = {r["skey"]: (r["u"], r["d"]) for r in P.slices(space, 4).where("factor_count = 4").collect()}
    cut = space.thresholds["temperature"]
    want = {}
    for m, s, b in itertools.product(["M1", "M2"], "AB", ["B1", "B2"]):
        held = [r for r in rows if (r[2], r[3], r[4]) == (m, s, b) and r[8] > cut]
        u, d = sum(r[7] for r in held), sum(r[6] for r in held)
        rest = sum(r[6] for r in rows) - d
        if u >= 150 and d / u >= rest / (30_000 - u):
            want[f"{m}|{s}|{b}|true"] = (u, d)
    assert got and got.items() <= want.items() and "M1|A|B1|true" in got
    assert not P.slices(P.mining_space(df, 3), 3).where("factor_count > 3").count()


def test_members_of_slices_come_from_the_cube_and_pruned_ones_from_their_rows(spark):
    """Rows are scanned again for pruned or null members only; the counts are those of all rows."""
    df = planted(spark, 3000).withColumn("batch_id", F.expr(
        "CASE WHEN pmod(xxhash64(inspection_id), 40) = 0 THEN inspection_id WHEN pmod(xxhash64(inspection_id), 40) <> 1 THEN batch_id END"))
    space = P.mining_space(df)
    passing = P.slices(space).select("skey")
    rows = P.slice_profiles(space, passing, checkpoint=False)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(batch_id" in plan.lower()
    got = {(r["skey"], r["kind"], r["key"]): (r["u"], r["d"], r["n"]) for r in rows.collect() if r["kind"] in P.CATS}
    want: dict = {}
    keys = {r[0] for r in passing.collect()}
    kept = {c: {r[c] for r in space.base.select(c).distinct().collect()} for c in P.CATS}
    assert len(kept["batch_id"]) == 11 and None in kept["batch_id"]
    for r in df.collect():
        for skey in keys:
            parts = skey.split("|")
            if any(p != "*" and r[c] != p for c, p in zip(P.CATS, parts)) or any(p != "*" for p in parts[3:]):
                continue
            for c in P.CATS:
                u, d, n = want.get((skey, c, r[c]), (0, 0, 0))
                want[(skey, c, r[c])] = (u + r["units_inspected"], d + r["defect_count"], n + 1)
    assert got == want and any(k[2] is None for k in got)
