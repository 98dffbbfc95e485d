import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from faultline.llm import exact_dedup, queries
from llm.helpers import ODD, docs, matches_oracle, rows_of


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    assert rows_of(exact_dedup.exact_groups(docs(spark, ODD))) == brute(ODD)
    assert exact_dedup.exact_groups(docs(spark, ODD).limit(0)).count() == 0


def test_hot_groups_with_few_counters(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"t{k % 50}") for k in range(900)]
    assert rows_of(exact_dedup.exact_groups(docs(spark, rows), counters=4)) == brute(rows)


def test_summaries_hold_every_frequent_digest(spark):
    rows = spark.range(0, 20_000, numPartitions=7).select(F.when(F.col("id") % 5 == 0, F.lit("a")).when(
        F.col("id") % 7 == 0, F.lit("b")).otherwise(F.col("id").cast("string")).cast("binary").alias("digest"))
    held = [bytes(r["digest"]) for r in exact_dedup.heavy_candidates(rows, 12).collect()]
    assert {b"a", b"b"} <= set(held) and len(held) <= 12


def test_drop_copies_keeps_columns_and_one_row(spark):
    df = docs(spark, ODD)
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    keep = {}
    for i, t in ODD:
        keep[t or ""] = max([x for x in (keep.get(t or ""), i) if x is not None], default=None)
    assert sorted((r["text"] or "", r["doc_id"] or -1) for r in left.collect()) == sorted((t, i or -1) for t, i in keep.items())
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_query_matches_sql(spark):
    matches_oracle(spark, queries.QUERIES["op2_exact_dedup"], queries.ORACLES["op2_exact_dedup"])
