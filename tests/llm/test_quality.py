import tracemalloc

import numpy as np
import pytest

from faultline.llm import quality, queries, words
from llm.helpers import ODD, docs

MID = "/root/testdata/sf0.01"


def test_chunks_cover_whole_texts():
    for n in (0, 1, quality.CHUNK, quality.CHUNK + 1, 5000, 12_345):
        at = quality.chunks(n)
        seen = np.zeros(max(n, 1), bool)
        for s in at:
            seen[s: s + quality.CHUNK] = True
        assert seen.all() and (at[-1] + quality.CHUNK >= n)


def test_gradient_is_the_derivative():
    net = quality.Network(1)
    rng = np.random.default_rng(2)
    net.w = {k: rng.normal(0, 0.3, v.shape) for k, v in net.w.items()}
    x = rng.integers(0, 256, (5, quality.CHUNK + quality.WIDTH - 1)).astype(np.uint8)
    off, y, weight = np.array([0, 2, 5]), np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        conv = sum(net.w["filters"][k][x[:, k: k + quality.CHUNK]] for k in range(quality.WIDTH))
        p = net.head(conv.max(axis=1), off)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    grad = net.gradient(x, off, y, weight)
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-5
        up = loss()
        net.w[k][at] = old - 1e-5
        down = loss()
        net.w[k][at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7)


def test_score_does_not_depend_on_the_slice():
    net = quality.Network(3)
    texts = [b"", b"short", b"abc " * 700, bytes(range(32, 127)) * 30]
    join = lambda ts: (np.frombuffer(b"".join(ts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in ts])]))
    alone = [net.score(*join([t]))[0] for t in texts]
    assert np.allclose(net.score(*join(texts)), alone, atol=1e-6)


def test_scoring_a_slice_takes_little_memory():
    """Two workers share an executor's memory with the JVM: a slice costs a few times its bytes."""
    net, rng = quality.Network(3), np.random.default_rng(4)
    sizes = np.array([0, 3, 200_000, *rng.integers(1, 5000, 2000)])
    data = rng.integers(32, 127, min(sizes.sum(), words.SLICE_BYTES)).astype(np.uint8)
    off = np.minimum(np.concatenate([[0], np.cumsum(sizes)]), len(data))
    tracemalloc.start()
    try:
        got = net.score(data, off)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == len(sizes) and peak < 8 * words.SLICE_BYTES


def test_odd_rows_and_missing_labels(spark):
    df = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(df, none).collect()} == {1.0}
    some = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (9, 0, 0), (13, 0, 0), (None, 1, 0), (5, 1, 0), (7, None, 0)],
                                 "doc_id long, quality int, toxic int")
    got = quality.classify(df, some).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality.classify(df.limit(0), some).count() == 0
    left = quality.drop_poor(df, some)
    assert left.columns == df.columns


def test_held_out_accuracy(spark):
    got = queries.op3(spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in got]
    assert len(got) > 60 and sum(right) / len(right) > 0.9
    assert sum(r["predicted"] for r in got if r["quality"] == 1) / sum(r["quality"] for r in got) > 0.93
