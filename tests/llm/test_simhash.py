import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from faultline.functions import components
from faultline.llm import queries, simhash
from llm.helpers import ODD, SMALL, docs, lower_az, rows_of, words


def fingerprint(text):
    w = words(lower_az(text))
    said = [" ".join(w[k: k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(marks):
    """Smallest id reachable of every (id, fingerprint), by comparing all pairs."""
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, f) in enumerate(marks):
        for j, (o, g) in enumerate(marks[:k]):
            if i is not None and o is not None and (i == o or (f ^ g).bit_count() <= 3):
                parent[find(k)] = find(j)
    least = defaultdict(list)
    for k, (i, _) in enumerate(marks):
        least[find(k)].append(i)
    return [None if i is None else min(least[find(k)]) for k, (i, _) in enumerate(marks)]


def brute(rows):
    marks = [(i, fingerprint(t)) for i, t in rows]
    return sorted(((i, f"{f:016x}", c) for (i, f), c in zip(marks, groups(marks), strict=True)), key=repr)


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def clouds(seed, centres=6, size=40, spread=4):
    """Fingerprints around centres, many of them in one half's neighbourhood."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(centres):
        middle = rng.getrandbits(64)
        for _ in range(size):
            f = middle
            for _ in range(rng.randrange(spread + 1)):
                f ^= 1 << rng.randrange(64)
            out.add(f)
            out.add((f & 0xFFFFFFFF) | rng.getrandbits(32) << 32)
    return sorted(out)


def components_of(spark, marks):
    df = spark.createDataFrame([(signed(f),) for f in marks], "fp long")
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.linked(df).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in pairs)
    of = {f: f for f in marks}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    return [find(f) for f in marks]


def same(spark, marks):
    assert components_of(spark, marks) == groups([(f, f) for f in marks])


def test_every_half_within_one_bit_is_covered(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        f = rng.getrandbits(64)
        for bit in (rng.randrange(64), None):
            pairs.append((signed(f), signed(f ^ (1 << bit) if bit is not None else f), bit))
    df = spark.createDataFrame(pairs, "x long, y long, bit int")
    low, high = simhash.homes(F.col("x"))
    near = simhash.covering(df.select(F.col("y").alias("fp")).distinct()).groupBy("fp").agg(F.collect_set("key").alias("keys"))
    got = df.join(near, df["y"] == near["fp"]).select("bit", F.array_contains("keys", low).alias("lo"), F.array_contains("keys", high).alias("hi"),
                                                      F.size("keys").alias("n")).collect()
    assert len(got) == len(pairs) and all(r["lo"] and r["hi"] and r["n"] <= 34 for r in got)


def test_links_of_clouds(spark):
    same(spark, clouds(3))


def test_crowded_anchors_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 2)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    same(spark, clouds(4, 3, 30, 6))


def test_fingerprints_are_sparks_hashes(spark):
    texts = ["One two  three four", "a b", "", None, "x\x0by\x0cz w"]
    got = simhash.fingerprints(pa.array(texts, pa.string()))
    assert [int(f) for f in got] == [fingerprint(t) for t in texts]
    said = spark.createDataFrame([("one two three",), ("two three four",)], "s string").select(F.xxhash64("s")).collect()
    hashes = np.array([r[0] for r in said]).view(np.uint64)
    assert int(got[0]) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > 2)


def test_odd_rows_and_empty_table(spark):
    df = docs(spark, ODD)
    assert rows_of(simhash.simhash_groups(df)) == brute(ODD)
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op11(spark, SMALL)) == brute(rows)


def test_rows_behind_an_explode_are_not_broadcast(spark, monkeypatch):
    """Spark sizes the anchors, 34 a fingerprint, by the file of the fingerprints."""
    plans, kept = [], simhash.materialize

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(simhash, "materialize", seen)
    out = simhash.simhash_groups(docs(spark, ODD))
    assert rows_of(out.select("doc_id", "fingerprint", "component_id")) == brute(ODD)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 4 and not [p for p in joins if "BroadcastExchange" in p]


def test_components_of_many_edges_are_not_broadcast(spark, monkeypatch):
    plans, kept = [], components.materialize

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(components, "materialize", seen)
    monkeypatch.setattr(components, "BROADCAST_ROWS", 5)
    edges = spark.createDataFrame([(k, k + 1) for k in range(20) if k != 9], "a long, b long")
    assert sorted(tuple(r) for r in components.components(edges).collect()) == [(k, 0 if k < 10 else 10) for k in range(21)]
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "BroadcastExchange" in p]
