"""Removal of long repeats between documents by recompression (op5).

Words are ``[^\\x20\\x09-\\x0D]+``; a window is ``WINDOW`` consecutive words of a document.  A word
goes if a window that covers it also starts in a document with a smaller id.

Round 0 names runs of one word, each later round names pairs: symbols fall into two halves by
a bit of their name, and each neighbour pair (left half, right half) becomes one symbol.  A
name is a 64-bit hash of what it stands for, so all tasks give equal substrings equal names
without asking each other, and inside two equal substrings the same symbols appear, except
near the ends.  For each symbol we keep the words its existence depends on (itself, and the
neighbours that left it unmerged).  A window's symbols are those whose dependence lies inside
it, so equal windows have equal symbols; each window is represented by the one with the
smallest name among those of the last round, of ``LONG`` words or more if there are such; a window without one looks in earlier rounds,
and is represented by its own hash if it has none there either (inside a long run).
Neighbouring windows share a representative: about one posting for twenty words.

Representatives that occur in two different texts reveal candidate windows; only those are
hashed in full (96 bits) and compared across the corpus, which gives for each the smallest
document.  Documents with one word sequence are one class: its smallest id stands for it in
all joins, the others lose everything by definition.  Aggregations combine map-side, so a
passage in a third of all documents is one row per task; joins on hot symbols are sorted
joins that adaptive execution can split.

Defined results: null, empty and wordless texts have 0 words, nothing removed and the digest
of the empty string; rows of one id with different texts do not shorten each other; a null
id neither loses nor takes words; equal rows are judged alike; an empty table gives an empty
table; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.session import discard, materialize

WINDOW = 50
#: Pair rounds.  Symbols then span four words and more, and nearly all windows hold several.
ROUNDS = 5
#: Symbols of so many words are preferred as representatives, as few texts share them by chance.
LONG = 6
#: Rounds whose symbols represent a window, the first that has one inside it.
LEVELS = (5, 2, 0)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _words(col: pa.Array, seeds: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words, one array per seed, and each text's offsets among them."""
    data, off = words.text_bytes(col)
    mask = words.NOT_SPACE[data]
    starts, ends, at = words.spans(mask, off)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in seeds], at
    codes, values = words.distinct(data, mask, starts, ends)
    return [words.hash_values(values, s)[codes] for s in seeds], at


def _window_hash(word: np.ndarray, window: int) -> np.ndarray:
    """Hash of each run of ``window`` words (those that cross texts are never used)."""
    n = len(word)
    if n < window:
        return np.zeros(0, np.uint64)
    total = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        total = total * _A + word[k: n - window + 1 + k]
    return words.mix(total)


class Grammar:
    """Symbols of all texts of a slice after round 0; ``pair`` runs one more round."""

    def __init__(self, word: np.ndarray, at: np.ndarray):
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        head = np.ones(len(word), bool)
        head[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(head)
        run = np.diff(np.append(start, len(word)))
        self.doc = doc[start]
        self.name = np.where(run > 1, words.mix(word[start] * _A + run.astype(np.uint64)), word[start])
        self.span = run
        self.lo, self.hi = start - 1, start + run + 1          # a run depends on both neighbours
        self.first, self.end = at[:-1] - 1, at[1:] + 1          # just outside each text
        self.rounds = 0

    def pair(self) -> None:
        self.rounds += 1
        n = len(self.name)
        left = words.mix(self.name ^ words.mix(np.array([self.rounds], np.uint64))) & np.uint64(1) == 0
        near = self.doc[1:] == self.doc[:-1]
        pair = np.zeros(n, bool)
        pair[:-1] = left[:-1] & ~left[1:] & near
        eaten = np.zeros(n, bool)
        eaten[1:] = pair[:-1]
        after_hi, before_lo = self.end[self.doc], self.first[self.doc]
        after_hi[:-1][near] = self.hi[1:][near]
        before_lo[1:][near] = self.lo[:-1][near]
        hi = np.where(left, after_hi, self.hi)                  # of a pair: its second part's
        lo = np.where(~left, before_lo, self.lo)
        name = self.name.copy()
        at = np.flatnonzero(pair)
        name[at] = words.mix((self.name[at] * _A + self.name[at + 1]) * _B + np.uint64(self.rounds))
        span = self.span.copy()
        span[at] += self.span[at + 1]
        keep = ~eaten
        self.name, self.lo, self.hi, self.doc, self.span = name[keep], lo[keep], hi[keep], self.doc[keep], span[keep]

    def representatives(self, p: np.ndarray, window: int) -> np.ndarray:
        """Index of the symbol that represents the window at each word of ``p``; -1 for none."""
        begin = np.searchsorted(self.lo, p, "left")
        count = np.searchsorted(self.hi, p + window, "right") - begin
        pick = np.full(len(p), -1)
        some = np.flatnonzero(count > 0)
        if len(some):
            order = np.lexsort((self.name, self.span < LONG))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            level, best = np.frexp(count[some])[1] - 1, np.empty(len(some), np.int64)
            for k in range(int(level.max()) + 1):               # minima of 2 ** k successive symbols
                if k:
                    half = 1 << k - 1
                    rank = np.minimum(rank[:-half], rank[half:])
                own = level == k
                b, c = begin[some[own]], count[some[own]]
                best[own] = np.minimum(rank[b], rank[b + c - (1 << k)])
            pick[some] = order[best]
        return pick


def window_names(word: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first words of all windows, names of their representatives); depends for each window
    on its words alone."""
    p = words.ranges(at[:-1], np.maximum(np.diff(at) - window + 1, 0))
    name, todo = np.zeros(len(p), np.uint64), np.arange(len(p))
    if not len(p):
        return p, name
    g = Grammar(word, at)
    held = {0: (g.name, g.lo, g.hi, g.span)}
    for _ in range(ROUNDS):
        g.pair()
        held[g.rounds] = (g.name, g.lo, g.hi, g.span)
    for level in LEVELS:
        g.name, g.lo, g.hi, g.span = held[level]
        pick = g.representatives(p[todo], window)
        name[todo[pick >= 0]] = g.name[pick[pick >= 0]]
        todo = todo[pick < 0]
    if len(todo):
        name[todo] = words.mix(_window_hash(word, window)[p[todo]] + _B)
    return p, name


POSTINGS = "doc_id long, mark long, c1 long, c2 long, n_words long, sym long, first int, many int"


def postings(df: DataFrame, doc_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """Per text one row with ``sym`` null, naming its word sequence (c1, c2), and one row per
    representative: ``many`` windows from word ``first`` on have it."""
    words.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "text"):
            (one, two), at = _words(part.column("text"), (0, 1))
            n = np.diff(at)
            name = []
            for word in (one, two):
                place = (np.arange(len(word)) - np.repeat(at[:-1], n)).astype(np.uint64)
                total = np.zeros(len(word) + 1, np.uint64)
                np.cumsum(words.mix(word + words.mix(place + _A)), out=total[1:])
                name.append(words.mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64))
            p, sym = window_names(one, at, window)
            doc = np.searchsorted(at, p, "right") - 1
            new = np.ones(len(p), bool)
            new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            many = np.diff(np.append(head, len(p)))
            sym = sym[head]
            who = np.concatenate([np.arange(part.num_rows), doc[head]])
            null = np.arange(len(who)) < part.num_rows
            pad = np.zeros(part.num_rows, np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").take(pa.array(who)), "mark": part.column("mark").take(pa.array(who)),
                "c1": name[0][who], "c2": name[1][who], "n_words": n[who],
                "sym": pa.array(np.concatenate([pad, sym.view(np.int64)]), mask=null),
                "first": pa.array(np.concatenate([pad, p[head] - at[doc[head]]]).astype(np.int32), mask=null),
                "many": pa.array(np.concatenate([pad, many]).astype(np.int32), mask=null)})

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"),
                     F.col(text).alias("text")).mapInArrow(run, POSTINGS)


def _full_windows(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, mark, at, h1, h2 (64 and 32 bits) of the candidate windows; ``rows`` has text and
    cand (first, many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "text"):
            (one, two), at = _words(part.column("text"), (0, 1))
            cand = part.column("cand")
            doc = np.repeat(np.arange(part.num_rows), np.asarray(cand.value_lengths()))
            first, many = (np.asarray(cand.flatten().field(k), dtype=np.int64) for k in ("first", "many"))
            p = words.ranges(first + at[doc], many)
            doc = np.repeat(doc, many)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").take(pa.array(doc)), "mark": part.column("mark").take(pa.array(doc)),
                "at": (p - at[doc]).astype(np.int32),
                "h1": _window_hash(one, window)[p].view(np.int64),
                "h2": (_window_hash(two, window)[p] >> np.uint64(32)).astype(np.uint32).view(np.int32)})

    return rows.mapInArrow(run, "doc_id long, mark long, at int, h1 long, h2 int")


def repeated_windows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, mark, whole, starts: texts that lose words, either all of them (``whole``) or
    those of the windows at ``starts`` (word numbers)."""
    posted = materialize(postings(df, doc_id, text, window).where("doc_id is not null"), "grammar")
    docs, posts = posted.where("sym is null"), posted.where("sym is not null")
    classes = materialize(docs.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "sequences")
    copies = materialize(docs.where(F.col("n_words") >= window).join(classes, ["c1", "c2"]).where("doc_id > rep").select(
        "doc_id", "mark").distinct(), "copies")
    shared = posts.groupBy("sym").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi").select("sym")
    heads = docs.join(classes, ["c1", "c2"]).where("doc_id = rep").select("doc_id", "mark").distinct()
    cand = posts.select("sym", "doc_id", "mark", "first", "many").join(shared, "sym").join(
        heads, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("first", "many")).alias("cand"))
    cand = materialize(cand, "candidates")
    discard(posted, classes)
    texts = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    full = materialize(_full_windows(texts.join(cand, ["doc_id", "mark"]), window), "windows")
    least = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    hit = full.join(least.select("h1", "h2", "lo"), ["h1", "h2"]).where("doc_id > lo").groupBy("doc_id", "mark").agg(
        F.collect_set("at").alias("starts"))
    repeats = materialize(hit.select("doc_id", "mark", F.lit(False).alias("whole"), "starts").unionByName(
        copies.select("doc_id", "mark", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("starts"))), "repeats")
    discard(cand, full, copies)
    return repeats


def _kept(text: str | None, whole: bool, starts: np.ndarray, window: int) -> tuple[int, int, bytes]:
    found = (text or "").encode().split()
    if whole:
        return len(found), len(found), b""
    if not len(starts):
        return len(found), 0, b" ".join(found)
    edge = np.zeros(len(found) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    stay = np.cumsum(edge)[:-1] == 0
    return len(found), int((~stay).sum()), b" ".join(w for w, k in zip(found, stay.tolist(), strict=True) if k)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   digest: bool = False) -> DataFrame:
    """Per row of ``df``: doc_id, n_words, n_removed and the kept words joined by one space:
    string ``kept``, or with ``digest`` their SHA-256 as ``kept_sha256``."""
    gone = repeated_windows(df, doc_id, text, window).withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    rows = rows.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("mark") == F.col("__mark")), "left").select(
        "doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "text"):
            lens = np.asarray(part.column("starts").value_lengths().fill_null(0), dtype=np.int64)
            flat = np.asarray(part.column("starts").flatten(), dtype=np.int64)
            off = np.concatenate([[0], np.cumsum(lens)])
            out = [_kept(t, w, flat[a:b], window) for t, w, a, b in zip(
                part.column("text").to_pylist(), part.column("whole").to_pylist(), off[:-1], off[1:], strict=True)]
            last = {"kept_sha256": [hashlib.sha256(k).hexdigest() for _, _, k in out]} if digest else \
                {"kept": [k.decode() for _, _, k in out]}
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n_words": pa.array([n for n, _, _ in out], pa.int64()),
                "n_removed": pa.array([n for _, n, _ in out], pa.int64())} | last)

    return rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")
