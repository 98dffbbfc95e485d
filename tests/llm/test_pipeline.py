import corpus_pipeline
from faultline.llm import quality
from llm import test_decontam, test_neardup
from llm.helpers import ODD, SMALL, docs


def test_stages_keep_the_columns_of_documents(spark):
    df = docs(spark, ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns, name
        assert stage(spark, df.limit(0), SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, SMALL).count() == len(ODD)


def test_run_is_brute_force(spark):
    """Given the classifier's decisions, which are learned, every other stage is exact."""
    full = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in quality.drop_poor(full, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    kept = sorted((i, rows[i]) for i in last.values())
    kept = [(i, rows[i]) for i, _, _, stays in test_neardup.brute(kept, corpus_pipeline.NEAR_PERCENT) if stays]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(r[0] for r in test_decontam.brute(kept, items) if not r[-1])
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert all(r["text"] == rows[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in got)
