import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import queries, substring
from llm.helpers import ODD, docs, matches_oracle, rows_of, words


def brute(rows, size):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k: k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k: k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def repeats(seed, alphabet, n=40):
    """Texts of few words with runs, periods and shared passages."""
    rng = random.Random(seed)
    passages = [[rng.choice(alphabet) for _ in range(rng.randrange(20, 90))] for _ in range(5)] + [[alphabet[0]] * 80, alphabet[:3] * 30]
    rows = []
    for k in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(alphabet) for _ in range(rng.randrange(40))]
        rows.append((rng.randrange(1000), "  ".join(w)))
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("alphabet", [["a", "b"], [f"w{k}" for k in range(300)]])
def test_equal_windows_have_equal_names(alphabet):
    rows = repeats(4, alphabet)
    (one,), at = substring._words(pa.array([t for _, t in rows]))
    p, name = substring.window_names(one, at)
    held = {}
    for start, n in zip(p, name):
        assert held.setdefault(one[start: start + substring.WINDOW].tobytes(), n) == n


@pytest.mark.parametrize("alphabet", [["a", "b"], [f"w{k}" for k in range(300)]])
def test_removals(spark, alphabet):
    rows = repeats(9, alphabet)
    assert rows_of(substring.remove_repeats(docs(spark, rows), digest=True)) == brute(rows, 50)


def test_odd_rows(spark):
    df = docs(spark, ODD)
    assert rows_of(substring.remove_repeats(df, digest=True)) == brute(ODD, 50)
    assert substring.remove_repeats(df.limit(0)).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in substring.remove_repeats(df).collect()}
    assert kept[8] == "end" and len(kept[7]) > 1000


def test_pairs_do_not_depend_on_what_is_around():
    rng = np.random.default_rng(1)
    inner = rng.integers(0, 50, 200).astype(np.uint64)
    held = []
    for _ in range(2):
        side = [rng.integers(0, 50, 70).astype(np.uint64) for _ in range(2)]
        word = np.concatenate([side[0], inner, side[1]])
        p, name = substring.window_names(word, np.array([0, len(word)]))
        held.append(name[(p >= 70) & (p <= 70 + 150)])
    assert (held[0] == held[1]).all()


def test_query_matches_sql(spark):
    matches_oracle(spark, queries.QUERIES["op5_substring_dedup"], queries.ORACLES["op5_substring_dedup"])
