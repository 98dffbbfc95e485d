import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from faultline.functions.components import components
from faultline.llm import neardup, queries
from llm.helpers import ODD, SMALL, docs, lower_az, rows_of, words


def shingle_set(text):
    w = words(lower_az(text))
    return frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        if rows[k][0] is not None:
            for x in s:
                holders[x].append(k)
    for k, s in enumerate(sets):
        both = Counter(j for x in s for j in holders[x] if j < k) if rows[k][0] is not None else {}
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    first = {}
    for k, (i, _) in enumerate(rows):                 # rows of one id are one document
        if i is not None and sets[k]:
            parent[find(k)] = find(first.setdefault(i, k))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        root = min(least[find(k)]) if i is not None else None
        out.append((i, len(sets[k]), root, i == root))
    return sorted(out, key=repr)


def near_copies(seed=2, bases=6, copies=25):
    rng = random.Random(seed)
    rows = []
    for b in range(bases):
        text = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.randrange(60, 260))]
        for _ in range(copies):
            own = list(text)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10 ** 6)}"
            rows.append((len(rows) * 7 % 1000, " ".join(own)))
    return rows


def test_shingles_are_exact():
    texts = [t for _, t in ODD]
    got, off = neardup.shingles(pa.array(texts, pa.string()))
    assert (off[1:] - off[:-1]).tolist() == [len(shingle_set(t)) for t in texts]


def test_components_of_near_copies(spark):
    rows = near_copies()
    got = neardup.near_duplicates(docs(spark, rows))
    assert rows_of(got) == brute(rows)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 4)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = near_copies(seed=5, bases=3, copies=50)
    assert rows_of(neardup.near_duplicates(docs(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    df = docs(spark, ODD)
    assert rows_of(neardup.near_duplicates(df)) == brute(ODD)
    left = neardup.drop_near_copies(df)
    assert left.columns == df.columns
    want = Counter(i for i, _, _, kept in brute(ODD) if kept)
    assert Counter(r["doc_id"] for r in left.collect()) == want


def test_empty_table(spark):
    assert neardup.near_duplicates(docs(spark, ODD).limit(0)).count() == 0


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op9(spark, SMALL)) == brute(rows)


def test_long_chain_is_one_component(spark):
    edges = spark.range(0, 300).selectExpr("(id * 37) % 301 AS a", "((id + 1) * 37) % 301 AS b")
    got = components(edges).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}
    assert components(edges.limit(0)).count() == 0


def test_shingles_are_sorted_text_by_text(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(200)] + [None, "", "a", "A b", "x " * 40]
    alone = [neardup.shingles(pa.array([t], pa.string()))[0].tolist() for t in texts]
    monkeypatch.setattr(np, "lexsort", None)
    total, off = neardup.shingles(pa.array(texts, pa.string()))
    assert [total[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == alone == [sorted(set(x)) for x in alone]
    assert [len(x) for x in alone] == [len(shingle_set(t)) for t in texts]
