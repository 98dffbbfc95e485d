import itertools
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from faultline.llm import queries, token_io
from llm.helpers import ODD, SMALL, docs


@pytest.mark.parametrize("counts, limit", [([5, 1, 1, 2, 9, 30], 20), ([5, 1, 1, 2, 9, 30], 3), ([1, 1], 1), ([7], 4),
                                           ([1, 2, 4, 8, 16], 3), ([3, 3, 3, 3], 2)])
def test_lengths_are_optimal(counts, limit):
    got = token_io.code_lengths(np.array(counts), limit)
    assert got.max() <= limit and sum(2.0 ** -got) <= 1
    best = min((sum(c * n for c, n in zip(counts, ls)) for ls in itertools.product(range(1, min(limit, 6) + 1), repeat=len(counts))
                if sum(2.0 ** -n for n in ls) <= 1))
    assert (got * counts).sum() == best


def test_pack_and_unpack():
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.2, 5000) % 3000
    seen, counts = np.unique(ids, return_counts=True)
    code = token_io.Code(seen, token_io.code_lengths(counts))
    payload, checks = code.pack(ids)
    n = np.full(len(checks), token_io.CHECK_IDS)
    n[-1] = len(ids) - token_io.CHECK_IDS * (len(checks) - 1)
    raw = np.frombuffer(payload, np.uint8)
    assert (code.unpack(raw, checks, n) == ids).all()
    assert (code.unpack(raw, checks[3:4], n[3:4]) == ids[3 * token_io.CHECK_IDS: 4 * token_io.CHECK_IDS]).all()


def test_files_hold_all_rows_in_order(spark, tmp_path, monkeypatch):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    path = str(tmp_path / "ids")
    token_io.write(docs(spark, ODD), path, P.path("byte_bpe_50k.json"))
    got = token_io.read(spark, path).orderBy("start").collect()
    want = sorted(((i if i is not None else -1, tk.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ODD),
                  key=lambda r: (r[0], np.array(r[1], "<u2").tobytes()))
    assert [(r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in got] == want
    assert [r["start"] for r in got] == [0, *itertools.accumulate(len(ids) for _, ids in want)][:-1]


def test_empty_table(spark, tmp_path):
    token_io.write(docs(spark, ODD).limit(0), str(tmp_path / "none"), P.path("byte_bpe_50k.json"))
    assert token_io.read(spark, str(tmp_path / "none")).count() == 0


def test_query_is_the_librarys(spark):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = queries.op8(spark, SMALL).orderBy("doc_id").collect()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    assert len(got) == len(rows)
    for g, r in zip(got, rows):
        ids = np.array(tk.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(g) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
