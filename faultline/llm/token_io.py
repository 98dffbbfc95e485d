"""Token ids in files of length-limited canonical Huffman code (op8).

``write`` encodes every whole text, appends the end id, counts all ids of the corpus, builds
one length-limited prefix code from the counts (package-merge) and writes the documents in
ascending ``doc_id`` order.  A file set is two Parquet folders below ``path``:

* ``code``: id, length.  Codes are canonical: shorter first, then by id.
* ``blocks``: part, block, first (ids of the part before the block), doc_ids, doc_sizes,
  checks, payload.  A block is a run of whole documents of about ``BLOCK_IDS`` ids (one long
  document is a block).  ``payload`` is its bit stream, most significant bit first, and
  ``checks`` the bit offset of every ``CHECK_IDS``-th id, little-endian 32 bit.  Blocks do
  not depend on each other, and decoding may begin at any check.

``read`` decodes by one table lookup per id, all checks of a slice of blocks in step.  The
driver holds only the counts per id (bounded by the vocabulary) and one total per written
part.

Defined results: a literal of one of the tokenizer file's added tokens (``<|endoftext|>``) is that
token's id, as in the library; a null or empty text is the end id alone; rows of equal ``doc_id`` are
ordered by their ids; no rows give empty folders; a corpus of one distinct id has codes of
one bit; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.llm.bpe import Memo, encode_texts
from faultline.session import materialize

BLOCK_IDS = 1 << 16
CHECK_IDS = 256
#: Longest code: the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 20
#: Ids decoded in one numpy pass (a longer block is one pass).
PASS_IDS = 1 << 20


# --- the tokenizer -----------------------------------------------------------------------------

#: The byte-level alphabet keeps these bytes as characters; the others, in order, follow from U+0100.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class AddedTokens:
    """The tokenizer file's added tokens, whose literals the library cuts out before it splits a text."""

    def __init__(self, spec: str):
        added = json.loads(spec).get("added_tokens") or []
        for t in added:
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
                raise ValueError(f"added token {t['content']!r} takes in or looks at its neighbours")
        self.ids = {t["content"].encode(): t["id"] for t in added}
        longest = sorted(self.ids, key=len, reverse=True)
        self.any = re.compile(b"|".join(map(re.escape, longest))) if longest else None

    def cut(self, col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The texts between the literals, how many each text has, which of them a literal follows, and its id."""
        data, off = words.text_bytes(col)
        blob = data.tobytes()
        if self.any is None or not self.any.search(blob):
            return col, np.ones(len(off) - 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts, counts, after, ids = [], [], [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            had, at = len(parts), a
            for m in self.any.finditer(blob, a, b):
                after.append(len(parts))
                ids.append(self.ids[m.group()])
                parts.append(blob[at: m.start()])
                at = m.end()
            parts.append(blob[at: b])
            counts.append(len(parts) - had)
        return pa.array(parts, pa.binary()).cast(pa.string()), np.array(counts), np.array(after), np.array(ids)


class LibraryEncoder:
    """Encodes distinct pieces with the tokenizers library, many per call.

    No piece holds the literal of an added token, so the library is set up without them.  The pieces go in already written in the byte-level alphabet, as one text with byte 0
    between them, which the library splits off before it merges; a piece that holds byte 0
    itself is encoded alone."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.spec = spec = json.dumps(json.loads(spec) | {"added_tokens": []})
        self.letters = np.zeros(256, np.uint32)
        self.letters[PRINTABLE] = PRINTABLE
        others = np.setdiff1d(np.arange(256), PRINTABLE)
        self.letters[others] = 0x100 + np.arange(len(others))
        self.many = Tokenizer.from_str(spec)
        self.many.pre_tokenizer = pre_tokenizers.Split(chr(self.letters[0]), "isolated")
        self.cut = self.many.token_to_id(chr(self.letters[0]))

    def _alone(self, value: bytes) -> np.ndarray:
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(self.spec)
        return np.array(t.encode(value.decode(), add_special_tokens=False).ids, np.int64)

    def __call__(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        odd = {k: self._alone(v) for k, v in enumerate(values) if b"\0" in v}
        held = b"\0".join([b" " if k in odd else v for k, v in enumerate(values)] if odd else values)
        text = self.letters[np.frombuffer(held, np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.many.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        cuts = np.flatnonzero(ids == self.cut)
        sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        flat = ids[ids != self.cut]
        if odd:
            lists = np.split(flat, np.cumsum(sizes)[:-1])
            lists = [odd.get(k, x) for k, x in enumerate(lists)]
            sizes, flat = np.array([len(x) for x in lists]), np.concatenate(lists)
        return flat, np.concatenate([[0], np.cumsum(sizes)])


@lru_cache(maxsize=2)
def _encoder(spec) -> tuple[AddedTokens, Memo]:
    return AddedTokens(words.worker_tables(spec)), Memo(LibraryEncoder(words.worker_tables(spec)))


def encode_whole(spec, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice, end to end, added tokens among them, and each text's offsets."""
    added, memo = _encoder(spec)
    between, counts, after, literal = added.cut(col)
    ids, off = encode_texts(memo, between)
    last = np.concatenate([[0], np.cumsum(counts)])             # parts before each text
    if len(after):
        ids = np.insert(ids.astype(np.int64), off[after + 1], literal)
        off = off + np.searchsorted(after, np.arange(len(off)))
    return ids, off[last]


def _spec(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def id_kind(tokenizer: str, end_id: int) -> str:
    from tokenizers import Tokenizer
    return "<u2" if max(Tokenizer.from_str(_spec(tokenizer)).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"


def token_ids(df: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``: the ids of each whole text and the end id, little-endian and
    unsigned, 16 bits each where the vocabulary and the end id allow it, else 32."""
    words.prepare(df.sparkSession)
    spec, kind = df.sparkSession.sparkContext.broadcast(_spec(tokenizer)), id_kind(tokenizer, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, text):
            ids, off = encode_whole(spec, part.column(text))
            ids = np.insert(ids.astype(kind), off[1:], end_id)
            ends = ((off + np.arange(len(off))) * ids.itemsize).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(doc_id).cast(pa.int64()),
                "ids": pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(ends), pa.py_buffer(ids)])})

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, ids binary")


def _binary(col: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array of ``kind``, and each value's offsets."""
    width = np.dtype(kind).itemsize
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = (np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8))[off[0]: off[-1]]
    return np.frombuffer(raw.tobytes(), kind), (off - off[0]) // width


# --- the code ----------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``limit`` (package-merge).

    Level by level the cheapest items pair into packages, which compete with the leaves one
    level up; a symbol's length is how many of the chosen 2n - 2 items hold it."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    levels, weight = [], np.zeros(0)
    for _ in range(limit):
        pairs = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaf, pairs])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)                       # which items of this level are leaves
        weight = merged[by]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())          # always the cheapest leaves
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


class Code:
    """Canonical code of ``ids`` with ``lengths``."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(lengths.max(initial=1))
        room = np.int64(1) << (self.bits - lengths)
        first = np.cumsum(room) - room
        size = int(ids.max(initial=0)) + 1
        self.word, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.word[ids], self.length[ids] = first >> (self.bits - lengths), lengths
        self.table = np.zeros(1 << self.bits, np.int32)           # id * 64 + length, by the next bits
        filled = np.repeat(ids * 64 + lengths, room)
        self.table[: len(filled)] = filled

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bit stream of ``ids`` and the bit offset of each ``CHECK_IDS``-th id."""
        length = self.length[ids]
        at = np.cumsum(length) - length
        total = int(length.sum())
        shifted = self.word[ids] << (32 - length - (at & 7)).astype(np.uint64)
        byte, n = at >> 3, (total + 7 >> 3) + 4
        out = np.zeros(n)
        for k in range(4):                                        # codes share bytes but no bits
            part = (shifted >> np.uint64(24 - 8 * k) & np.uint64(255)).astype(np.float64)
            out += np.bincount(byte + k, part, n)
        return out[: total + 7 >> 3].astype(np.uint8).tobytes(), at[::CHECK_IDS].astype("<u4")

    def unpack(self, payload: np.ndarray, start: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Decode runs of ids side by side: run k has ``counts[k]`` ids from bit ``start[k]``."""
        padded = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint64)
        out = np.empty(int(counts.sum()), np.int64)
        put = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, put, counts = start[order].astype(np.int64), put[order], counts[order]
        ends = np.searchsorted(-counts, -np.arange(int(counts.max(initial=0))), "left")
        low = np.uint64(32 - self.bits)
        for step, live in enumerate(ends):
            now = at[:live]
            byte = now >> 3
            window = (padded[byte] << np.uint64(32) | padded[byte + 1] << np.uint64(24) | padded[byte + 2] << np.uint64(16)
                      | padded[byte + 3] << np.uint64(8) | padded[byte + 4])
            window = window >> (8 - (now & 7)).astype(np.uint64) & np.uint64(0xFFFFFFFF)
            entry = self.table[(window >> low).astype(np.int64)]
            out[put[:live] + step] = entry >> 6
            at[:live] = now + (entry & 63)
        return out


@lru_cache(maxsize=2)
def _code(held) -> Code:
    return Code(*words.worker_tables(held))


def count_ids(encoded: DataFrame, kind: str) -> DataFrame:
    """``id, n`` over all ids; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            now = np.bincount(_binary(batch.column("ids"), kind)[0])
            size = max(len(total), len(now))
            total = np.pad(total, (0, size - len(total))) + np.pad(now, (0, size - len(now)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen.astype(np.int64), "n": total[seen]})

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- files -------------------------------------------------------------------------------------

BLOCKS = ("part int, block long, first long, doc_ids array<long>, doc_sizes array<int>, "
          "checks binary, payload binary")


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode all texts and write the file set below ``path``."""
    spark, kind = df.sparkSession, id_kind(tokenizer, end_id)
    encoded = materialize(token_ids(df, tokenizer, end_id, doc_id, text), "token-ids")
    counts = np.array([tuple(r) for r in count_ids(encoded, kind).collect()], np.int64).reshape(-1, 2)
    lengths = code_lengths(counts[:, 1])
    spark.createDataFrame(list(zip(counts[:, 0].tolist(), lengths.tolist(), strict=True)), "id long, length long") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    held = spark.sparkContext.broadcast((counts[:, 0], lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, first, block = _code(held), TaskContext.get().partitionId(), 0, 0
        docs, sizes, held_ids, held_n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal first, block, docs, sizes, held_ids, held_n
            ids = np.concatenate(held_ids).astype(np.int64)
            payload, checks = code.pack(ids)
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": [block], "first": [first],
                "doc_ids": pa.array([docs], pa.list_(pa.int64())), "doc_sizes": pa.array([sizes], pa.list_(pa.int32())),
                "checks": [checks.tobytes()], "payload": [payload]})
            first, block, docs, sizes, held_ids, held_n = first + len(ids), block + 1, [], [], [], 0
            return row

        for batch in batches:
            flat, off = _binary(batch.column("ids"), kind)
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                docs.append(doc)
                sizes.append(int(off[k + 1] - off[k]))
                held_ids.append(flat[off[k]: off[k + 1]])
                held_n += sizes[-1]
                if held_n >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    encoded.repartitionByRange(F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids") \
        .mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of blocks of at most ``PASS_IDS`` ids, or one block."""
    for batch in batches:
        lists = batch.column("doc_sizes")
        total = np.concatenate([[0], np.cumsum(np.asarray(lists.flatten(), dtype=np.int64))])
        off = total[np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))])]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + PASS_IDS, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and the ids of each document, decoded from the files:
    array<int> ``ids``, or with ``digest`` the CRC of the ids as little-endian 32-bit numbers."""
    words.prepare(spark)
    code = np.array([tuple(r) for r in spark.read.parquet(f"{path}/code").collect()], np.int64).reshape(-1, 2)
    held = spark.sparkContext.broadcast((code[:, 0], code[:, 1]))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, parts = 0, {}
    for part, n in sorted(map(tuple, totals.collect())):        # one row per written part
        parts[part], before = before, before + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(held)
        for one in _passes(batches):
            sizes = np.asarray(one.column("doc_sizes").flatten(), dtype=np.int64)
            held_by = np.asarray(one.column("doc_sizes").value_lengths(), dtype=np.int64)
            edges = np.concatenate([[0], np.cumsum(held_by)])
            off = np.concatenate([[0], np.cumsum(sizes)])
            n = np.diff(off[edges])                                   # ids of each block
            checks, check_off = _binary(one.column("checks"), "<u4")
            payload, byte_off = _binary(one.column("payload"), "u1")
            counts = np.full(len(checks), CHECK_IDS)
            counts[check_off[1:] - 1] = n - CHECK_IDS * (np.diff(check_off) - 1)
            ids = code.unpack(payload, checks + np.repeat(byte_off[:-1] * 8, np.diff(check_off)), counts)
            base = np.array([parts[p] for p in one.column("part").to_pylist()]) + np.asarray(one.column("first"))
            start = off[:-1] + np.repeat(base - off[edges[:-1]], held_by)
            out = {"doc_id": one.column("doc_ids").flatten(), "start": start, "n_tokens": sizes}
            if digest:
                raw = ids.astype("<u4")
                out["ids_crc32"] = pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)], pa.int64())
            else:
                out["ids"] = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    last = "ids_crc32 long" if digest else "ids array<int>"
    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
