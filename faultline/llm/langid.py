"""Language of whole texts with spans of mixed text (op4).

Words are ``[^\\x20\\x09-\\x0D]+``.  A word's script (by code-point ranges, from its first letter)
narrows the languages to those whose training text uses that script; each candidate scores
the word by its byte trigrams (A-Z lower-cased, with a blank at both ends).  Viterbi over the
words with a fixed penalty for every change of language labels the text; equal neighbours form
spans.  The prediction is the language whose spans hold most letters, its score their share.

Learning counts trigrams (hashed to ``BUCKETS``) and scripts per language over all training
rows, added up in each task before the shuffle.  The driver gets at most languages x
(BUCKETS + scripts) numbers, and the model is broadcast.  Labelling is row by row: the texts
of a slice go through Viterbi side by side, step by step; no shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0; so is
everything if nothing was learned; text whose letters belong to no learned script gets the
language with most training words, and score 0; ties go to the language that sorts first;
null labels teach nothing; equal rows get equal results; empty tables give empty tables;
extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import pretokens, words

BUCKETS = 1 << 15
#: Penalty (in nats) of a change of language between two words.
SWITCH = 12.0
#: A language uses a script if so much of its training words are in it.
SCRIPT_SHARE = 0.01
#: Most that a single word can speak for or against a language.
WORD_LIMIT = 6.0
UNKNOWN = "und"
#: Bytes of text that go through Viterbi together.
PASS_BYTES = 6 << 20
#: First code points of script blocks, in order; 0 is no script that matters.
RANGES = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
          (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"),
          (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
          (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
          (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other")]
SCRIPTS = sorted({s for _, s in RANGES})
_EDGES = np.array([c for c, _ in RANGES], np.uint32)
_SCRIPT = np.array([0] + [SCRIPTS.index(s) for _, s in RANGES])


@dataclass
class Model:
    """Learned languages, log-probabilities per bucket, and the scripts each one uses."""

    langs: list[str]
    logp: np.ndarray        # (BUCKETS, langs)
    uses: np.ndarray        # (scripts, langs)
    most: int               # language with most training words


@dataclass
class Words:
    """Distinct words of a slice: trigram buckets (ragged), script or -1, letters; and the texts' words."""

    codes: np.ndarray
    at: np.ndarray
    grams: np.ndarray
    gram_off: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def read_words(col: pa.Array) -> Words:
    data, off = words.text_bytes(col)
    data = words.LOWER[data]
    mask = words.NOT_SPACE[data]
    starts, ends, at = words.spans(mask, off)
    codes, values = words.distinct(data, mask, starts, ends)
    n = len(values)
    bufs = values.buffers()
    edge = np.frombuffer(bufs[1], np.int32)[:n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    flat = np.frombuffer(bufs[2], np.uint8)[: edge[-1]] if n else np.zeros(0, np.uint8)
    # " word ": as many trigrams as bytes
    wide = edge + 2 * np.arange(n + 1)
    held = np.full(int(wide[-1]) + 2, 0x20, np.uint32)
    held[words.ranges(wide[:-1] + 1, np.diff(edge))] = flat
    key = (held[:-2] * np.uint32(0x9E3779B1) ^ held[1:-1] * np.uint32(0x85EBCA6B) ^ held[2:] * np.uint32(0xC2B2AE35))
    key = (key ^ key >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    grams = (key >> np.uint32(17)).astype(np.int64)[words.ranges(wide[:-1], np.diff(edge))]
    points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(n), np.diff(edge))[(flat & 0xC0) != 0x80]
    letter = np.flatnonzero(pretokens.classes()[points] == pretokens.LETTER)
    letters = np.bincount(of[letter], minlength=n)
    script = np.full(n, -1)
    first = letter[::-1]
    script[of[first]] = _SCRIPT[np.searchsorted(_EDGES, points[first], "right")]
    return Words(codes, at, grams, edge, script, letters)


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Model of the labelled rows of ``df``; all of them are read."""
    words.prepare(df.sparkSession)
    size = BUCKETS + len(SCRIPTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in words.slices(batches, "text"):
            seen = read_words(part.column("text"))
            label = np.array(part.column("lang").to_pylist())
            doc = np.repeat(np.arange(part.num_rows), np.diff(seen.at))
            for name in np.unique(label):
                n = np.bincount(seen.codes[(label == name)[doc]], minlength=len(seen.script))
                n[seen.script < 0] = 0
                grams = np.bincount(seen.grams, np.repeat(n, np.diff(seen.gram_off)), BUCKETS)
                scripts = np.bincount(np.maximum(seen.script, 0), n, len(SCRIPTS))
                now = np.concatenate([grams, scripts]).astype(np.int64)
                total[str(name)] = total[str(name)] + now if str(name) in total else now
        for name, now in total.items():
            at = np.flatnonzero(now)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "at": at.astype(np.int32), "n": now[at]})

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((size, len(langs)))
    if langs:
        table[counts["at"], counts["lang"].map({k: i for i, k in enumerate(langs)})] = counts["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logp = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, logp.astype(np.float32), uses, int(scripts.sum(axis=0).argmax()) if langs else 0)


def word_scores(model: Model, seen: Words) -> np.ndarray:
    """Score of each distinct word for each language; 0 throughout for words that say nothing."""
    if not len(seen.script):
        return np.zeros((0, len(model.langs)), np.float32)
    score = np.add.reduceat(model.logp[seen.grams], seen.gram_off[:-1], axis=0)
    may = model.uses[np.maximum(seen.script, 0)] & (seen.script >= 0)[:, None]
    best = np.where(may, score, -np.inf).max(axis=1, keepdims=True)
    score = np.maximum(np.where(may, score - best, -WORD_LIMIT), -WORD_LIMIT)
    score[~may.any(axis=1)] = 0
    return score.astype(np.float32)


def viterbi(score: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word: the best path of each text, all texts side by side.

    ``score``: (words, languages); ``at``: offsets of the texts' words."""
    n, k = score.shape
    path = np.zeros(n, np.int16)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, size = at[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")
    came = np.empty((n, k), np.int16)                   # language before, on the best path to each
    own = np.arange(k, dtype=np.int16)
    value = np.zeros((0, k), np.float32)
    last = np.zeros(len(order), np.int16)
    for t in range(longest):
        now = begin[: live[t]] + t
        if t == 0:
            value = score[now]
        else:
            if live[t] < len(value):                    # texts that ended
                last[live[t]: len(value)] = value[live[t]:].argmax(axis=1)
                value = value[: live[t]]
            best = value.argmax(axis=1)
            jump = value[np.arange(len(best)), best] - np.float32(switch)
            stay = value >= jump[:, None]
            came[now] = np.where(stay, own, best.astype(np.int16)[:, None])
            value = np.where(stay, value, jump[:, None]) + score[now]
    if longest:
        last[: len(value)] = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        now = begin[: live[t]] + t
        path[now] = last[: live[t]]
        if t:
            last[: live[t]] = came[now, last[: live[t]]]
    return path


SPANS = "array<struct<first:int,words:int,lang:string>>"


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``lang_score`` and ``lang_spans`` (first word, words, language)."""
    words.prepare(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    made = ("lang_pred", "lang_score", "lang_spans")
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = words.worker_tables(held)
        names = pa.array(model.langs, pa.string())
        for part in words.slices(batches, text, PASS_BYTES):
            seen = read_words(part.column(text))
            n, k = part.num_rows, len(model.langs)
            doc = np.repeat(np.arange(n), np.diff(seen.at))
            letters = seen.letters[seen.codes]
            any_letter = np.bincount(doc, letters, n) > 0
            pred, score = np.full(n, -1), np.zeros(n)
            spans = pa.array([[]] * n, kind)
            if k and len(doc):
                path = viterbi(word_scores(model, seen)[seen.codes], seen.at)
                known = model.uses[np.maximum(seen.script, 0)].any(axis=1) & (seen.script >= 0)
                weight = np.where(known[seen.codes], letters, 0)
                share = np.bincount(doc * k + path, weight, n * k).reshape(n, k)
                held_by = share.sum(axis=1)
                pred = np.where(any_letter, np.where(held_by > 0, share.argmax(axis=1), model.most), -1)
                score = np.where(held_by > 0, share.max(axis=1) / np.maximum(held_by, 1), 0.0)
                head = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]))
                flat = pa.StructArray.from_arrays([
                    pa.array((head - seen.at[doc[head]]).astype(np.int32)),
                    pa.array(np.diff(np.append(head, len(path))).astype(np.int32)), names.take(pa.array(path[head].astype(np.int64)))],
                    fields=list(kind.value_type))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(head, seen.at).astype(np.int32)), flat, type=kind)
            cols = {c: part.column(c) for c in part.schema.names if c not in made}
            said = pa.array([model.langs[p] if p >= 0 else UNKNOWN for p in pred], pa.string())
            yield pa.RecordBatch.from_pydict(cols | {"lang_pred": said, "lang_score": score, "lang_spans": spans})

    return df.mapInArrow(run, words.with_columns(df, *zip(made, ("string", "double", SPANS), strict=True)))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans; learned from rows outside the held-out fold
    (CRC of the id as text, modulo 4, is 2)."""
    out = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = learn(docs.where(~out), text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"),
                                       F.col("lang_spans").alias("spans"))
