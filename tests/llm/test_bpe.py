import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import bpe, pretokens, queries, words
from llm.helpers import ODD, SMALL, docs

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = ["a", "s", "re", "ve", "ll", "'", "''", "'s", "'ll", " ", "  ", "\n", "\t", "\xa0", "é", "ñ", "1", "²", "!", "--",
          "\U0001F600", "漢", "the", "ing", "\x00", "\x1c"]


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=20))
def test_boundaries_are_the_patterns(texts):
    data, off = words.text_bytes(pa.array(texts, pa.string()))
    codes, values, at = pretokens.pieces(data, off)
    said = [v.decode() for v in values.to_pylist()]
    for k, t in enumerate(texts):
        assert [said[c] for c in codes[at[k]: at[k + 1]]] == regex.findall(P.PATTERN, t.replace("\x1c", "!")) or "\x1c" in t
        assert "".join(said[c] for c in codes[at[k]: at[k + 1]]) == t


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=20).map("".join),
                                st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"]), max_size=30)),
                      min_size=1, max_size=10))
def test_ids_are_the_librarys(vocab, texts):
    ids, off = bpe.encode_texts(bpe.Memo(vocab.encode_pieces, 5), pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[off[k]: off[k + 1]].tolist() == LIBRARY.encode_ordinary(t)


def test_long_pieces(vocab):
    texts = ["a" * 700, " " * 900 + "x", "=-" * 400, "é" * 300]
    ids, off = bpe.encode_texts(bpe.Memo(vocab.encode_pieces), pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[off[k]: off[k + 1]].tolist() == LIBRARY.encode_ordinary(t)


def test_prefix_table_appends_and_edits(vocab):
    rng = random.Random(3)
    table = bpe.PrefixTable(vocab)
    for _ in range(30):
        table.append(rng.choice([b"the", b"ing", b"un", b"re", b"xq", b"z"]))
        assert table.last == bpe.PrefixTable(vocab, table.piece).last
    assert table.ids() == LIBRARY.encode_single_token(table.piece) if table.piece in RANKS else table.ids()
    long = bpe.PrefixTable(vocab, b"antidisestablishmentarianism" * 20)
    for _ in range(5):
        start = rng.randrange(60)
        filled = long.replace(start, start + rng.randrange(4), b"qu"[: rng.randrange(3)])
        assert long.last == bpe.PrefixTable(vocab, long.piece).last
        assert filled < len(long.piece) / 2                       # the end was not filled again
    assert LIBRARY.decode_bytes(long.ids()) == long.piece


def test_rows_pass_through_and_decode_back(spark):
    df = docs(spark, ODD)
    path = P.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(df, path)
    assert ids.columns == [*df.columns, "ids"]
    got = bpe.decode(ids, path, out="back").select("doc_id", "text", "ids", "back").collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r["ids"] == LIBRARY.encode_ordinary(r["text"] or "")
        assert r["back"] == (r["text"] or "")
    assert bpe.decode(bpe.encode(df.limit(0), path), path).count() == 0
    assert bpe.round_trip(df.limit(0), path).count() == 0


def test_query_is_the_librarys(spark):
    got = {r["doc_id"]: r for r in queries.op7(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_int_map():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000))
    held = bpe.IntMap(keys, np.arange(len(keys), dtype=np.int32))
    assert (held.get(keys) == np.arange(len(keys))).all()
    assert (held.get(keys + (1 << 41)) == bpe.NONE).all()


def test_one_pass_returns_ids_and_their_text(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BOTH_BYTES", 50)
    got = bpe.encode_decode(docs(spark, ODD), P.path("byte_bpe_50k.tiktoken")).collect()
    want = sorted(((i, LIBRARY.encode_ordinary(t or ""), t or "") for i, t in ODD), key=repr)
    assert sorted(((r["doc_id"], r["ids"], r["text"]) for r in got), key=repr) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe.encode_decode(docs(spark, ODD).limit(0), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_memory_of_pieces_is_bounded_by_bytes(vocab):
    memo = bpe.Memo(vocab.encode_pieces, 1000)
    for k in range(20):
        memo.lists([b"piece%d" % k, b"x" * 300])
        assert memo.held <= 1000 + 2 * (300 + 40 + bpe.ENTRY_BYTES) + 400


def test_memory_looks_a_piece_up_once(vocab):
    class Piece(bytes):
        looked = 0

        def __hash__(self):
            Piece.looked += 1
            return bytes.__hash__(self)

    said = [Piece(b"piece%d" % k) for k in range(50)] + [Piece(b"piece3")]
    memo = bpe.Memo(vocab.encode_pieces)
    for _ in range(2):
        before = Piece.looked
        flat, off, number = memo.lists(said)
        assert [flat[off[n]: off[n + 1]].tolist() for n in number] == [vocab.encode_pieces([v])[0].tolist() for v in map(bytes, said)]
    assert number[50] == number[3] and Piece.looked - before == len(said)      # known ones; not once for 'in' and once more
    memo.encode = None
    for _ in range(2):
        try:
            memo.lists([b"new"])
            raise AssertionError
        except TypeError:
            assert not memo.number                            # a piece that was not encoded is not remembered
