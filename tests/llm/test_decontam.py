import hashlib
import re

from faultline.llm import decontam, queries
from llm.helpers import BASE, ODD, docs, lower_az, matches_oracle, rows_of

ITEM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(rows, items, size=10):
    found = lambda t: re.findall(ITEM, lower_az(t))
    windows = {}
    for item, t in items:
        w = found(t)
        if item is not None and w:
            n = min(size, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k: k + n]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, seen = found(t), set(), set()
        for win in windows:
            n = len(win)
            for k in range(len(w) - n + 1):
                if tuple(w[k: k + n]) == win:
                    hit.update(range(k, k + n))
                    seen |= windows[win]
        out.append((i, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, BASE), (1, "a"), (2, None), (3, "..."), (4, BASE + " and more than this"), (None, "dup"), (20, "Ñandú x"),
         (5, "fox"), (6, "no, ID!"), (7, "x y")]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_odd_rows(spark):
    rows = [r for r in ODD if r[0] not in (7, 8)] + [(30, "pre. " + BASE.replace(" ", ", ") + " post"), (31, " ".join(BASE.split()[:9])),
                                                    (32, "fox Fox FOX fox"), (33, BASE + " " + BASE)]
    df = docs(spark, rows)
    assert rows_of(decontam.contamination(df, items(spark, ITEMS))) == brute(rows, ITEMS)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = [(30, BASE), (31, "fox"), (32, "nothing")]
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert rows_of(decontam.contamination(docs(spark, rows), items(spark, ITEMS))) == brute(rows, ITEMS)


def test_no_shuffle_carries_texts_per_word(spark):
    rows = spark.createDataFrame([(1, 2, ["a", "b"])], "doc_id long, mark long, w array<string>")
    rare = spark.createDataFrame([("a b", 2, "a", 0)], "words string, size int, rare string, place int")
    plan = decontam.proposals(rows, rare.hint("merge"), False)
    assert plan.columns == ["doc_id", "mark", "start", "size", "words"] and [tuple(r) for r in plan.collect()] == [(1, 2, 0, 2, "a b")]
    line = next(x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate posexplode" in x)
    assert " w#" not in line.split("posexplode(")[1].split("),", 1)[1]        # what goes on above the explosion


def test_empty_tables(spark):
    df = docs(spark, ODD)
    assert not any(r["contaminated"] for r in decontam.contamination(df, items(spark, [])).collect())
    assert decontam.contamination(df.limit(0), items(spark, ITEMS)).count() == 0
    assert decontam.drop_contaminated(df, items(spark, [])).count() == len(ODD)


def test_drop_keeps_clean_rows_whole(spark):
    df = docs(spark, ODD)
    left = decontam.drop_contaminated(df, items(spark, [(1, BASE)]))
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in left.collect()) == sorted((i or -1) for i, t in ODD if lower_az(t) != lower_az(BASE))


def test_no_python_on_the_main_path(spark):
    plan = decontam.contamination(docs(spark, ODD), items(spark, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_query_matches_sql(spark):
    name = "op6_benchmark_decontamination"
    matches_oracle(spark, queries.QUERIES[name], queries.ORACLES[name])
