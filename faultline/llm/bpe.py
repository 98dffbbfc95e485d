"""Byte-level BPE by prefix dynamic programming (op7).

For every byte prefix of a piece of text exactly one token can be the last one of the
prefix's encoding: the one that ends there and is *compatible* with the last token of the
prefix before it (the merges, replayed, never bridge the boundary between the two).  The
table of these last tokens is all that encoding needs.  It is filled left to right, so text
can be appended without touching what is there, and after an edit only the positions from
the edit to where old and new tables agree again are refilled (:class:`PrefixTable`).

In bulk (:func:`encode`) the distinct pieces of a slice of texts are encoded together: one
numpy step per prefix length, over all pieces.  Texts are split at the vocabulary's public
pattern first, each match is encoded by itself, and a worker keeps what it encoded in a
bounded table.  The vocabulary (bounded: one entry per rank) is read on the driver and
broadcast; texts are handled whole and independently, so there is no shuffle.

Defined results: a null or empty text has no ids and decodes to the empty text; rows are
handled one by one, so repeated rows, repeated ids, ties and extra columns change nothing;
an empty table gives an empty table; text is valid UTF-8, as in any Spark string column.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm import pretokens, words

#: Bytes of pieces, ids and table entries that a worker remembers before it starts anew; an entry counts ENTRY_BYTES.
MEMO_BYTES, ENTRY_BYTES = 64 << 20, 160
#: Bytes of text that are encoded and decoded at a time where both the ids and the text are returned.
BOTH_BYTES = 1 << 20
NONE = -1


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, blank, rank), by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f.read().splitlines() if line]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class IntMap:
    """Whole-number keys to whole numbers, looked up for an array of keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, NONE, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == NONE]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], values[free[first]]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = self.values[slot]
        todo = np.flatnonzero((found != keys) & (found != NONE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            out[todo] = self.values[slot[todo]]
            todo = todo[(found != keys[todo]) & (found != NONE)]
        return out


class Vocabulary:
    """Lookup tables of a rank vocabulary; built once, small, sent to the workers."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        rank = {t: k for k, t in enumerate(tokens)}
        self.whole = rank
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.left = np.full(self.size, NONE, np.int32)
        self.right = np.full(self.size, NONE, np.int32)
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, t in enumerate(tokens):
            if len(t) > 1 and (halves := _last_merge(t, rank)):
                self.left[k], self.right[k] = halves
            at = 0
            for b in t:
                at = nodes.setdefault((at, b), len(nodes) + 1)
            ends[at] = k
        self.steps = IntMap(np.array([n * 256 + b for n, b in nodes], np.int64),
                            np.fromiter(nodes.values(), np.int32, len(nodes)))
        #: Nodes behind the first byte and the first two, where most steps are taken.
        self.one, self.two = np.full(1 << 8, NONE, np.int32), np.full(1 << 16, NONE, np.int32)
        for (at, b), node in nodes.items():
            if not at:
                self.one[b] = node
        for b in np.flatnonzero(self.one != NONE).tolist():
            self.two[b << 8: b + 1 << 8] = self.steps.get(self.one[b].astype(np.int64) * 256 + np.arange(256))
        self.token_at = np.full(len(nodes) + 1, NONE, np.int32)
        self.token_at[list(ends)] = list(ends.values())
        made = np.flatnonzero(self.left != NONE)
        self.merges = IntMap(self.left[made].astype(np.int64) << 32 | self.right[made], made.astype(np.int32))
        #: When a token came to be: bytes before all merges, then by rank.
        self.time = np.where(self.left == NONE, NONE, np.arange(self.size))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of a's bytes followed by b's is just (a, b).

        Undoes the merges inside both, the latest first.  The two tokens that touch at the
        boundary at any moment must not merge earlier than what was undone to reach it; of
        equal merges the left one goes first."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 30, np.int64)
        while len(live):
            bridge = self.merges.get(x << 32 | y)
            bad = (bridge != NONE) & (bridge < limit)
            out[live[bad]] = False
            tx, ty = self.time[x], self.time[y]
            go = ~bad & ((tx != NONE) | (ty != NONE))
            live, x, y, tx, ty = live[go], x[go], y[go], tx[go], ty[go]
            undo_x = tx > ty
            limit = np.where(undo_x, x, y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return out

    def last_tokens(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Last token of every byte prefix of every piece, at the prefix's last byte.

        ``data``/``off``: the pieces' bytes end to end and their offsets; none is empty."""
        n = len(data)
        stop = np.repeat(off[1:], np.diff(off))
        head = np.repeat(off[:-1], np.diff(off))
        # all tokens that occur: from each byte walk down the trie while it has a child
        at, node, length = np.arange(n), np.zeros(n, np.int64), 0
        starts, ends, tokens = [], [], []
        while len(at):
            if length == 0:
                node = self.one[data]
            elif length == 1:
                node = self.two[data[at].astype(np.int64) << 8 | data[at + 1]]
            else:
                node = self.steps.get(node.astype(np.int64) * 256 + data[at + length])
            length += 1
            on = node != NONE
            at, node = at[on], node[on]
            token = self.token_at[node]
            hit = token != NONE
            starts.append(at[hit])
            ends.append(at[hit] + length)
            tokens.append(token[hit])
            on = at + length < stop[at]
            at, node = at[on], node[on]
        if not starts:
            return np.zeros(0, np.int32)
        start, end, token = np.concatenate(starts), np.concatenate(ends), np.concatenate(tokens)
        size = end - head[start]                        # of the prefix that the token would end
        order = np.argsort(size.astype(np.uint16) if size.max() < 1 << 16 else size, kind="stable")
        start, end, token, size = start[order], end[order], token[order], size[order]
        edges = np.searchsorted(size, np.arange(1, int(size[-1]) + 2))
        last = np.full(n, NONE, np.int32)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            s, e, t = start[lo:hi], end[lo:hi], token[lo:hi]
            inner = s != head[s]
            last[e[~inner] - 1] = t[~inner]
            s, e, t = s[inner], e[inner], t[inner]
            ok = self.compatible(last[s - 1], t)
            last[e[ok] - 1] = t[ok]
        return last

    def trace(self, last: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, read from the prefix table backwards; flat with offsets."""
        width = np.diff(self.off)
        at = off[1:].copy()
        live = np.arange(len(at))
        counts = np.zeros(len(at), np.int64)
        whose, found = [], []
        while len(live):
            token = last[at[live] - 1]
            whose.append(live)
            found.append(token)
            counts[live] += 1
            at[live] -= width[token]
            live = live[at[live] > off[:-1][live]]
        out = np.zeros(len(off), np.int64)
        np.cumsum(counts, out=out[1:])
        flat = np.empty(out[-1], np.int32)
        put = out[1:].copy()
        for who, token in zip(whose, found, strict=True):
            put[who] -= 1
            flat[put[who]] = token
        return flat, out

    def encode_pieces(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct non-empty pieces.  A piece that is a token is that token."""
        data = np.frombuffer(b"".join(values), np.uint8)
        off = np.zeros(len(values) + 1, np.int64)
        np.cumsum([len(v) for v in values], out=off[1:])
        last = self.last_tokens(data, off)
        single = np.fromiter((self.whole.get(v, NONE) for v in values), np.int32, len(values))
        is_token = single != NONE
        last[off[1:][is_token] - 1] = single[is_token]
        return self.trace(last, off)


def _last_merge(token: bytes, rank: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes ``token``."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 30))
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    found = [rank.get(p) for p in parts]
    return None if None in found else (found[0], found[1])


class PrefixTable:
    """The prefix table of one piece of bytes, kept open for appends and edits."""

    def __init__(self, vocab: Vocabulary, piece: bytes = b""):
        self.vocab, self.piece, self.last = vocab, b"", []
        self._longest = int(np.diff(vocab.off).max())
        self.append(piece)

    def _fill(self, piece: bytes, end: int, last: list[int]) -> int:
        for start in range(max(0, end - self._longest), end):
            token = self.vocab.whole.get(piece[start:end])
            if token is not None and (start == 0 or self.vocab.compatible(
                    np.array([last[start - 1]]), np.array([token]))[0]):
                return token
        raise ValueError("the vocabulary lacks a byte of this piece")

    def append(self, more: bytes) -> PrefixTable:
        """Exact: the table of what was there does not change."""
        self.piece += more
        for end in range(len(self.last) + 1, len(self.piece) + 1):
            self.last.append(self._fill(self.piece, end, self.last))
        return self

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``piece[start:stop]``; returns how many positions were filled anew.

        Behind the edit, filling ends once as many successive entries as the longest token
        has bytes equal the old ones: a later entry depends on no others."""
        piece, old = self.piece[:start] + new + self.piece[stop:], self.last
        last, same = old[:start], 0
        shift = len(new) - (stop - start)
        for end in range(start + 1, len(piece) + 1):
            last.append(self._fill(piece, end, last))
            behind = end - 1 - shift
            same = same + 1 if end > start + len(new) and last[-1] == old[behind] else 0
            if same >= self._longest:
                last += old[behind + 1:]
                filled = end - start
                break
        else:
            filled = len(piece) - start
        self.piece, self.last = piece, last
        return filled

    def ids(self) -> list[int]:
        if self.piece in self.vocab.whole:
            return [self.vocab.whole[self.piece]]
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end - 1])
            end -= int(self.vocab.off[out[-1] + 1] - self.vocab.off[out[-1]])
        return out[::-1]


class Memo:
    """A worker's memory of encoded pieces, bounded by bytes: ``limit`` and what one slice adds."""

    def __init__(self, encode, limit: int = MEMO_BYTES):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.held = 0
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__      # a new piece gets the next number
        self.flat = np.zeros(1 << 16, np.uint16)
        self.off = np.zeros(1 << 14, np.int64)

    def _room(self, name: str, size: int) -> np.ndarray:
        held = getattr(self, name)
        if size > len(held):
            setattr(self, name, held := np.concatenate([held, np.zeros(max(size, len(held) * 2) - len(held), held.dtype)]))
        return held

    def lists(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, offsets, which list each value has)."""
        if self.held > self.limit:
            self._clear()
        have = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, values), np.int64, len(values))
        if len(self.number) > have:
            fresh = np.flatnonzero(number >= have)
            fresh = fresh[np.unique(number[fresh], return_index=True)[1]]
            new = [values[k] for k in fresh.tolist()]
            try:
                flat, off = self.encode(new)
            except Exception:
                self._clear()                                   # no number without its ids
                raise
            used = int(self.off[have])
            if flat.max(initial=0) > np.iinfo(self.flat.dtype).max:
                self.flat = self.flat.astype(np.uint32)
            self._room("flat", used + len(flat))[used: used + len(flat)] = flat
            self._room("off", have + len(new) + 1)[have + 1: have + len(new) + 1] = off[1:] + used
            self.held += sum(map(len, new)) + ENTRY_BYTES * len(new) + 2 * len(flat)
        return self.flat, self.off, number


def encode_texts(memo: Memo, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice, end to end, and each text's offsets among them."""
    data, off = words.text_bytes(col)
    codes, values, at = pretokens.pieces(data, off)
    flat, lists, number = memo.lists(values.to_pylist())
    ids, ends = words.gather(flat, lists, number[codes])
    return ids, ends[at]


@lru_cache(maxsize=1)
def _memo(held) -> Memo:
    return Memo(words.worker_tables(held).encode_pieces)


def vocabulary(df: DataFrame, path: str):
    """Broadcast tables of a rank file: bounded by the vocabulary, not by the data."""
    words.prepare(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path)))


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with array<int> ``out``: the ids of each whole text by the ranks in ``path``."""
    held = vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, text):
            ids, off = encode_texts(_memo(held), part.column(text))
            cols = {n: part.column(n) for n in part.schema.names if n != out}
            yield pa.RecordBatch.from_pydict(cols | {out: _lists(ids, off)})

    return df.mapInArrow(run, words.with_columns(df, (out, "array<int>")))


def _decoded(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> pa.Array:
    """Texts of the lists of ids that ``off`` cuts ``ids`` into."""
    raw, at = words.gather(v.flat, v.off, ids)
    raw, at = raw.tobytes(), at[off]
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with string ``out``: the bytes of the ids, as UTF-8.  Null ids decode to ''."""
    held = vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.worker_tables(held)
        for part in words.list_slices(batches, ids):
            col = part.column(ids)
            off = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))])
            cols = {n: part.column(n) for n in part.schema.names if n != out}
            yield pa.RecordBatch.from_pydict(cols | {out: _decoded(v, np.asarray(col.flatten()), off)})

    return df.mapInArrow(run, words.with_columns(df, (out, "string")))


def encode_decode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, text``: each text's ids, and the text that these decode to, made in
    one pass over slices of BOTH_BYTES, so that a task holds one vocabulary and one slice."""
    held = vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.worker_tables(held)
        for part in words.slices(batches, text, BOTH_BYTES):
            ids, off = encode_texts(_memo(held), part.column(text))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(doc_id).cast(pa.int64()), "n_tokens": pa.array(np.diff(off)),
                "ids": _lists(ids, off), "text": _decoded(v, ids, off)})

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, text string")


def round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and return digests of both:
    ``doc_id, n_tokens, ids_sha256`` (of decimal ids joined by one space), ``decoded_sha256``."""
    held = vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.worker_tables(held)
        digits = [b" %d" % k for k in range(v.size)]
        digit_off = np.concatenate([[0], np.cumsum([len(d) for d in digits])]).astype(np.int64)
        digit = np.frombuffer(b"".join(digits), np.uint8)
        for part in words.slices(batches, text):
            ids, off = encode_texts(_memo(held), part.column(text))
            said, ends = words.gather(digit, digit_off, ids)
            raw, stops = words.gather(v.flat, v.off, ids)
            said, raw = said.tobytes(), raw.tobytes()
            rows = list(zip(off[:-1], off[1:], strict=True))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(doc_id).cast(pa.int64()), "n_tokens": pa.array(np.diff(off)),
                "ids_sha256": [hashlib.sha256(said[ends[a] + 1: ends[b]]).hexdigest() for a, b in rows],
                "decoded_sha256": [hashlib.sha256(raw[stops[a]: stops[b]]).hexdigest() for a, b in rows]})

    return df.select(doc_id, text).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
