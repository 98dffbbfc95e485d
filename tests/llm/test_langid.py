import itertools

import numpy as np

from faultline.llm import langid, queries
from llm.helpers import ODD, SMALL, docs


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    sizes = [4, 0, 1, 6, 3]
    at = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.normal(0, 3, (at[-1], 3)).astype(np.float32)
    path = langid.viterbi(score, at, switch=2.0)
    worth = lambda own, p: sum(own[k, x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
    for lo, hi in itertools.pairwise(at):
        if hi > lo:
            own = score[lo:hi]
            best = max(worth(own, p) for p in itertools.product(range(3), repeat=hi - lo))
            assert abs(worth(own, path[lo:hi]) - best) < 1e-4


def test_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op4(spark, SMALL).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_mixed_texts_and_scripts(spark):
    train = spark.createDataFrame([(1, "the house and the garden of the king with the children", "en"),
                                   (2, "das haus und der garten des königs mit den kindern nicht", "de"),
                                   (3, "дом и сад короля с детьми и собакой", "ru"), (4, None, "en"), (5, "x", None)],
                                  "doc_id long, text string, lang string")
    model = langid.learn(train)
    assert model.langs == ["de", "en", "ru"]
    mixed = "the house of the king and the children with the garden das haus und der garten mit den kindern nicht дом короля и сад"
    rows = [(1, mixed), (2, "дом 123"), (3, "12 34 !"), (4, None), (5, "漢字"), (6, "")]
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, rows).select("doc_id", "text"), model).collect()}
    assert [s["lang"] for s in got[1]["lang_spans"]] == ["en", "de", "ru"]
    assert sum(s["words"] for s in got[1]["lang_spans"]) == len(mixed.split())
    assert (got[2]["lang_pred"], got[2]["lang_score"]) == ("ru", 1.0)
    assert [got[k]["lang_pred"] for k in (3, 4, 6)] == ["und"] * 3
    assert got[5]["lang_pred"] == "de" and got[5]["lang_score"] == 0


def test_odd_rows_and_nothing_learned(spark):
    df = docs(spark, ODD)
    got = langid.identify(df).collect()
    assert len(got) == len(ODD)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for r, (_, t) in zip(
        sorted(got, key=lambda r: r["doc_id"] or -1), sorted(ODD, key=lambda x: x[0] or -1)) if r["doc_id"] not in (10, 12, None))
    assert langid.identify(df.limit(0)).count() == 0
    from pyspark.sql import functions as F
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
