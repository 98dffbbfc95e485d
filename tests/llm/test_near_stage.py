"""The pipeline's near-dedup stage drops near copies from a similarity of 0.80 on; op9 keeps 0.85."""

import random

import pytest

import corpus_pipeline
from faultline.llm import neardup
from llm.helpers import SMALL, docs
from llm.test_neardup import shingle_set


def kept_by_brute_force(rows, percent):
    """Ids that no path of links joins to a smaller id; ids are distinct."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return sorted(i for i, r in root.items() if i == r)


def spread(seed=3, bases=8, copies=8):
    """Copies of a few texts with so many words changed that similarities lie around 0.80 and 0.85."""
    rng, rows = random.Random(seed), []
    for b in range(bases):
        text = [f"b{b}w{rng.randrange(10 ** 6)}" for _ in range(204)]
        for _ in range(copies):
            own = list(text)
            for k in rng.sample(range(4, 200), rng.randrange(0, 6)):
                own[k] = f"z{rng.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    return rows


def test_stage_is_brute_force_at_80(spark):
    rows = spread()
    at_80, at_85 = kept_by_brute_force(rows, 80), kept_by_brute_force(rows, 85)
    assert len(at_80) < len(at_85)                    # the rows tell the two thresholds apart
    got = corpus_pipeline.near_copies(spark, docs(spark, rows), SMALL)
    assert sorted(r["doc_id"] for r in got.collect()) == at_80
    op9 = neardup.near_duplicates(docs(spark, rows)).where("kept")
    assert sorted(r["doc_id"] for r in op9.collect()) == at_85


@pytest.mark.parametrize("few, block", [(4, 8)])
def test_threshold_holds_in_blocks(spark, monkeypatch, few, block):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = spread(seed=4, bases=2, copies=40)
    got = corpus_pipeline.near_copies(spark, docs(spark, rows), SMALL)
    assert sorted(r["doc_id"] for r in got.collect()) == kept_by_brute_force(rows, 80)
