"""Vectorised text helpers shared by the operators that run numpy inside Spark tasks.

Every helper takes one Arrow slice of whole texts: ``data`` is the UTF-8 bytes of all texts
of the slice end to end and ``off`` the ``n + 1`` byte offsets of the texts in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from faultline.session import ship_package

#: Bytes of text that one numpy pass handles; bounds a worker's memory (a longer single text is one pass).
SLICE_BYTES = 3 << 20

#: White space between words: space and U+0009 to U+000D.
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


#: Bytes of rows that Spark hands to Python at a time.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Before Python runs in tasks: send the package to the workers and bound the batches they
    get by bytes, as rows of long texts are large."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_columns(df: DataFrame, *made: tuple[str, str]) -> StructType:
    """Schema of ``df`` with the columns ``made`` (name, type) new or replaced, at the end."""
    names = {name for name, _ in made}
    new = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in made))
    return StructType([f for f in df.schema if f.name not in names] + list(new))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, however it spells its own."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def list_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES >> 2) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds at most ``limit`` list elements, or one row."""
    for batch in batches:
        total = np.concatenate([[0], np.cumsum(np.asarray(batch.column(column).value_lengths().fill_null(0)))])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of 1 in ``mask`` that stay inside one text, and
    the ``n + 1`` offsets of each text's runs among them."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty(len(mask) + 1, np.uint8)
    before[0] = 0
    before[1:] = mask
    before[off[:-1]] = 0
    starts = np.flatnonzero(mask > before[:-1])
    before[:-1] = mask
    before[-1] = 0
    before[off[1:]] = 0
    ends = np.flatnonzero(mask > before[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def distinct(data: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the spans (which ``mask`` selects from ``data``) and their distinct values."""
    off = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=off[1:])
    held = pa.py_buffer(np.ascontiguousarray(data[mask.view(bool)]))
    arr = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), held])
    coded = arr.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_values(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit content hash of each binary value; depends on nothing but bytes and ``seed``."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    bufs = values.buffers()
    off = np.frombuffer(bufs[1], np.int32)[values.offset: values.offset + n + 1].astype(np.int64)
    data = (np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8))[off[0]: off[-1]]
    off = off - off[0]
    lens = np.diff(off)
    powers = np.ones(int(lens.max(initial=0)) + 1, np.uint64)
    powers[1:] = np.uint64(_BASES[seed % 2])
    powers = np.multiply.accumulate(powers)
    byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64((2 * seed + 1) * 0x632BE59BD9B4E019 & _MASK))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte[data] * powers[np.arange(len(data)) - np.repeat(off[:-1], lens)], out=total[1:])
    return mix(total[off[1:]] - total[off[:-1]] + mix(lens.astype(np.uint64) + np.uint64(seed + 1)))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0] + 1, ... (counts[0] of them), then those of starts[1], ..."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def gather(flat: np.ndarray, off: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the lists ``codes`` of the ragged array (``flat``, ``off``); also their offsets."""
    counts = (off[1:] - off[:-1])[codes]
    out = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return flat[ranges(off[:-1][codes], counts)], out


def worker_tables(held):
    """Value of a Spark broadcast, or the value itself outside of Spark."""
    return held.value if hasattr(held, "value") else held
