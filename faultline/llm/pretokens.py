"""Splits UTF-8 text at the boundaries of the byte-level vocabularies' public pattern
(``public_tokenizers.PATTERN``), for all texts of a slice at once.

Letters and numbers are Unicode categories L* and N*, white space is the Unicode property
White_Space, as in the libraries that encode with these vocabularies.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
                        np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def boundaries(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions at which the pattern's matches start, in all texts of the slice.

    Matches cover every byte of a text, so each ends where the next starts or its text ends."""
    if not len(data):
        return np.zeros(0, np.int64)
    if data.max() < 0x80:
        points, at = data, None
        heads = off
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        heads = np.searchsorted(at, off)
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)       # of a text; the end of the slice counts as one
    first[heads] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # a run of white space before another run gives up its last character: a space joins what follows
    after = np.flatnonzero(start[1:n] & ~first[1:n] & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    # contractions: an apostrophe that starts a match, with s, t, m, d, re, ve or ll after it
    mark = np.flatnonzero(start[:n] & (points == 0x27))
    mark = mark[~first[mark + 1]]
    if len(mark):
        one = points[mark + 1]
        two = np.where(first[mark + 2] if len(mark) else False, 0, points[np.minimum(mark + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    start = np.flatnonzero(start[:n])
    return start if at is None else at[start]


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the matches in order, the distinct matches, and each text's offsets among them."""
    starts = boundaries(data, off)
    edge = np.empty(len(starts) + 1, np.int32)
    edge[:-1], edge[-1] = starts, len(data)
    arr = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(
        np.ascontiguousarray(data))])
    coded = arr.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary, np.searchsorted(starts, off)
