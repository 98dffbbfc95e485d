"""Root-cause helpers: ordinal encoding of wide categoricals and the tree's split table."""


from faultline.operators import investigate as C
from faultline.sources.fixtures import inspections

from conftest import SF_SMALL


def test_wide_categoricals_get_alphabetical_codes(spark):
    df = inspections(spark, SF_SMALL)
    feats, names = C.feature_frame(df, "STANDARD")
    got = {r["batch_id"]: r["batch_id_idx"] for r in feats.select("batch_id", "batch_id_idx").distinct().collect()}
    expected = {v: float(i) for i, v in enumerate(sorted(got))}
    assert got == expected
    splits, imps = C.decision_tree(df, "STANDARD")
    assert imps.count() == len(names)
    assert all(0 <= r["importance_pct"] <= 100 for r in splits.collect())


def test_contribution_rows_have_lift_at_least_one(spark):
    rows = C.contribution(inspections(spark, SF_SMALL), "STANDARD").collect()
    assert rows and all(r["lift"] >= 1.0 for r in rows)
    assert [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)
