"""Quality of whole texts by a byte-level convolutional network in numpy (op3).

Network.  A text is cut into chunks of ``CHUNK`` bytes that start every ``STEP`` bytes, so the
chunks overlap and cover it to the end.  ``FILTERS`` learned filters of ``WIDTH`` bytes run over
every position; a filter is a table of 256 weights per offset, so a convolution is a sum of
table rows.  Each chunk keeps each filter's maximum (ReLU), a hidden layer follows, hidden
units are max-pooled and mean-pooled over the chunks of the text, and a logistic unit gives one
probability that the text is of label 1.

Training (Adam, cross-entropy with the classes weighted alike) runs on the driver over a
bounded sample of labelled rows: ``SAMPLE`` texts of each label, those with the smallest hash
of the text, each with at most ``SAMPLE_CHUNKS`` evenly spread chunks.  Scoring reads every
chunk of every text, in tasks, with the small weights broadcast; there is no shuffle of texts.

Defined results: texts shorter than a chunk are padded with byte 0, so null and empty texts
are scored as one chunk of padding; without labels of both kinds every score is the share of label 1 (1 if
there are none); repeated rows get equal scores; ``lang``, ``source``, ids and labels are
no inputs; an empty table gives an empty table; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words

CHUNK, STEP, WIDTH = 512, 384, 6
FILTERS, HIDDEN = 16, 16
#: Most texts of each label that are learned from, chunks of each, and chunks that one pass over it reads.
SAMPLE, SAMPLE_CHUNKS, TRAIN_CHUNKS = 2000, 24, 6
EPOCHS, BATCH, RATE = 12, 32, 0.01
#: Bytes of text that one numpy pass scores; its filter responses take 64 times that.
PASS_BYTES = 1 << 14
THRESHOLD = 0.7


def chunks(size: int) -> np.ndarray:
    """Start of each chunk of a text of ``size`` bytes; the last one ends at its end."""
    if size <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, size - CHUNK, STEP)
    return np.append(starts, size - CHUNK)


class Network:
    """Weights, forward pass and gradient."""

    SHAPES = {"filters": (WIDTH, 256, FILTERS), "shift": (FILTERS,), "hidden": (FILTERS, HIDDEN), "hshift": (HIDDEN,),
              "out": (2 * HIDDEN,), "oshift": (1,)}

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = {"filters": 0.15, "hidden": 0.35, "out": 0.25}
        self.w = {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32)
                  for k, s in self.SHAPES.items()}

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at each position of ``data`` (which ends with WIDTH - 1 pad bytes)."""
        n = len(data) - WIDTH + 1
        total = np.take(self.w["filters"][0], data[:n], axis=0)
        for k in range(1, WIDTH):
            total += np.take(self.w["filters"][k], data[k: k + n], axis=0)
        return total

    def pooled(self, hidden: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = np.diff(off)[:, None]
        return np.concatenate([np.maximum.reduceat(hidden, off[:-1], axis=0),
                               np.add.reduceat(hidden, off[:-1], axis=0) / n], axis=1)

    def head(self, top: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probabilities from the chunks' pooled filters."""
        hidden = np.tanh(np.maximum(top + self.w["shift"], 0) @ self.w["hidden"] + self.w["hshift"])
        z = self.pooled(hidden, off) @ self.w["out"] + self.w["oshift"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of each whole text of a slice, chunk by chunk."""
        tops, counts = [], []
        # texts apart by pad bytes, so that no filter sees two of them
        size = np.maximum(np.diff(off), CHUNK)
        room = size + WIDTH - 1
        begin = np.cumsum(room) - room
        held = np.zeros(int(room.sum()) + WIDTH - 1, np.uint8)
        starts, ends = [], []
        for b, n, lo, hi in zip(begin, size, off[:-1], off[1:], strict=True):
            held[b: b + hi - lo] = data[lo: hi]
            c = chunks(int(n)) + b
            starts.append(c)
            ends.append(np.minimum(c + CHUNK, b + n))
            counts.append(len(c))
        start, end = np.concatenate(starts), np.concatenate(ends)
        at = 0
        while at < len(start):                                  # positions of some chunks at a time
            stop = max(at + 1, int(np.searchsorted(start, start[at] + PASS_BYTES)))
            lo, hi = start[at], int(end[at:stop].max())
            seen = self.responses(held[lo: hi + WIDTH - 1])
            edge = np.stack([start[at:stop], end[at:stop]], axis=1).ravel() - lo
            seen = np.concatenate([seen, seen[-1:]])            # the last end is a valid index
            tops.append(np.maximum.reduceat(seen, edge, axis=0)[::2])
            at = stop
        return self.head(np.concatenate(tops), np.concatenate([[0], np.cumsum(counts)]))

    def gradient(self, x: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted cross-entropy over texts whose chunks are rows of ``x``
        (CHUNK + WIDTH - 1 bytes each)."""
        w, n = self.w, x.shape[0]
        conv = np.take(w["filters"][0], x[:, :CHUNK], axis=0)
        for k in range(1, WIDTH):
            conv += np.take(w["filters"][k], x[:, k: k + CHUNK], axis=0)
        where = conv.argmax(axis=1)                             # (chunk, filter)
        top = np.take_along_axis(conv, where[:, None, :], axis=1)[:, 0, :] + w["shift"]
        act = np.maximum(top, 0)
        hidden = np.tanh(act @ w["hidden"] + w["hshift"])
        pool = self.pooled(hidden, off)
        p = 1 / (1 + np.exp(-np.clip(pool @ w["out"] + w["oshift"], -30, 30)))
        dz = (p - y) * weight / weight.sum()
        doc = np.repeat(np.arange(len(y)), np.diff(off))
        dpool = dz[:, None] * w["out"]
        best = hidden == pool[doc, :HIDDEN]
        dh = best * dpool[doc, :HIDDEN] + dpool[doc, HIDDEN:] / np.diff(off)[doc][:, None]
        da = dh * (1 - hidden ** 2)
        dtop = (da @ w["hidden"].T) * (top > 0)
        filters = np.zeros(WIDTH * 256 * FILTERS)
        f = np.broadcast_to(np.arange(FILTERS), (n, FILTERS))
        for k in range(WIDTH):
            byte = np.take_along_axis(x, where + k, axis=1).astype(np.int64)
            filters += np.bincount(((k * 256 + byte) * FILTERS + f).ravel(), dtop.ravel(), len(filters))
        return {"filters": filters.reshape(self.SHAPES["filters"]), "shift": dtop.sum(axis=0), "hidden": act.T @ da,
                "hshift": da.sum(axis=0), "out": pool.T @ dz, "oshift": dz.sum(keepdims=True)}


def cut(text: bytes, most: int | None = None) -> list[bytes]:
    """Chunks of a text, at most ``most`` and evenly spread, padded to a chunk's size."""
    at = chunks(len(text))
    if most and len(at) > most:
        at = at[np.linspace(0, len(at) - 1, most).astype(int)]
    return [text[s: s + CHUNK].ljust(CHUNK, b"\0") for s in at]


def train(texts: list[list[bytes]], labels: list[int], seed: int = 7) -> Network:
    """Network fitted to the chunks of texts with 0/1 labels."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            rows, off = [], [0]
            for k in order[lo: lo + BATCH]:
                c = texts[k]
                if len(c) > TRAIN_CHUNKS:                       # other chunks each time
                    c = [c[i] for i in rng.choice(len(c), TRAIN_CHUNKS, replace=False)]
                rows += [t.ljust(CHUNK + WIDTH - 1, b"\0") for t in c]
                off.append(len(rows))
            x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
            own = order[lo: lo + BATCH]
            grad = net.gradient(x, np.array(off), y[own], weight[own])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                net.w[k] = (net.w[k] - rate * move).astype(np.float32)
    return net


def fold(doc_id: str = "doc_id"):
    """0 to 3 by the CRC of the id as text; 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE) -> Network | float:
    """Network learned from at most ``sample`` labelled rows of each label outside the held-out
    fold; the share of label 1 where a label is missing."""
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where(
        "y in (0, 1) and id is not null").groupBy("id").agg(F.min("y").alias("y"))
    rows = docs.where(fold(doc_id) != 2).select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    # different texts of each label, the smallest hashes first: grouped before and behind the shuffle, then a
    # bounded top-k per label, not of a group in one task
    order = F.xxhash64("t", F.lit("sample"))
    known = rows.select("id", order.alias("h")).join(marked, "id").groupBy("h", "y").agg(F.min("id").alias("id"))
    taken = [known.where(F.col("y") == y).orderBy("h").limit(sample) for y in (0, 1)]
    picked = taken[0].unionByName(taken[1]).collect()
    ones = sum(r["y"] for r in picked)
    if not ones or ones == len(picked):
        return 1.0 if ones or not picked else 0.0
    keys = docs.sparkSession.createDataFrame([(r["id"], r["h"], r["y"]) for r in picked], "id long, h long, y int")
    words.prepare(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "t"):
            texts = [cut(t.encode(), SAMPLE_CHUNKS) for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_pydict({"h": part.column("h"), "y": part.column("y"),
                                              "chunks": pa.array(texts, pa.list_(pa.binary()))})

    # one row of each sampled text comes to the driver, however often it is there
    held = rows.withColumn("h", order).join(F.broadcast(keys), ["id", "h"]).select("h", "t", "y").dropDuplicates(["h", "y"]).mapInArrow(
        pieces, "h long, y int, chunks array<binary>").collect()
    held = sorted({(r["h"], r["y"]): [bytes(c) for c in r["chunks"]] for r in held}.items())
    return train([c for _, c in held], [y for (_, y), _ in held])


def scores(df: DataFrame, model: Network | float, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with double ``out``: the probability that the row's whole text is of label 1."""
    if not isinstance(model, Network):
        return df.withColumn(out, F.lit(float(model)))
    words.prepare(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = words.worker_tables(held)
        for part in words.slices(batches, text):
            data, off = words.text_bytes(part.column(text))
            cols = {n: part.column(n) for n in part.schema.names if n != out}
            yield pa.RecordBatch.from_pydict(cols | {out: net.score(data, off).astype(np.float64)})

    return df.mapInArrow(run, words.with_columns(df, (out, "double")))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit(docs, labels, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == 2).alias("held_out"), F.col(text).alias("text"))
    return scores(rows, model).select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score",
                                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    (score,) = words.unused(docs, "own_score")
    return scores(docs, fit(docs, labels, doc_id, text), text, score).where(F.col(score) >= threshold).drop(score)
