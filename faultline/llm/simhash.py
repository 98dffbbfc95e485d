"""SimHash near-duplicates by anchor-point covering (op11).

A text's words (A-Z lower-cased) give shingles of ``SHINGLE`` words, repeats included, joined by
one space; a fingerprint has a bit set where over half of the shingles' XXH64 values have it.
Fingerprints that differ in at most ``DISTANCE`` = 3 of 64 bits are linked.

Three differing bits leave at most one in one of the two 32-bit halves, so each half is covered
by itself with a threshold of one.  The anchors of a half are the words of the Hamming (31, 26)
code on bits 1 to 31, with bit 0 free: a perfect code, so every half is within its covering
radius, one, of exactly one anchor, its home.  A half is replicated to all anchors within
radius plus threshold, 16 or 17 of them: bit k is given the number k, the syndrome is the XOR
of the numbers of the set bits, and those anchors are the half with bits i and i XOR syndrome
flipped, for every i (number 0 is no bit), and the home with bit 0 flipped.  If two halves
differ in one bit at most, the home of either is among the anchors of the other.

Per anchor, only the fingerprints at home there meet those that were replicated to it.  First
all meet one of the homes, drawn by a hash, and links are contracted to components; where an
anchor has several homes and components, homes meet the replicas of other components.  Anchors
with up to FEW homes do that in a join; more crowded ones are dealt anew by each byte of the
other half (three differing bits leave one of its four bytes equal), cut into blocks, and a
block pair returns a forest of the links found in it.  No anchor, however crowded, lands in one
task, and pairs that are connected already are not listed.

Moved between tasks: 17 anchors of 16 bytes for each half of each distinct fingerprint.  All
joins shuffle; nothing is broadcast, as sizes behind an explode are not known beforehand.

Defined results: null and wordless texts have fingerprint zero, linked like any other; equal
fingerprints are linked; rows of one id are one document that has the links of all its rows,
each row with its own fingerprint; a row with a null id links with nothing and its
component_id is null; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.components import components
from faultline.llm import words
from faultline.session import discard, materialize, shuffled

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Homes of an anchor that meet its replicas in a join; more are compared in blocks of at most BLOCK.
FEW, BLOCK = 64, 2048


def fingerprints(col: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of each text."""
    data, off = words.text_bytes(col)
    data = words.LOWER[data]
    mask = words.NOT_SPACE[data]
    starts, ends, at = words.spans(mask, off)
    # the words end to end, one space behind each
    closed = np.cumsum(ends - starts + 1)
    opened = closed - (ends - starts + 1)
    text = np.full(int(closed[-1]) if len(closed) else 0, 0x20, np.uint8)
    if len(text):
        held = np.ones(len(text), bool)
        held[closed - 1] = False
        text[held] = data[mask.view(bool)]
    n = np.diff(at)
    width = np.minimum(n, size)
    count = np.where(n > 0, n - width + 1, 0)
    first = words.ranges(at[:-1], count)
    last = first + np.repeat(width, count) - 1
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(opened[first].tolist(), (closed[last] - 1).tolist(), strict=True)),
                         np.uint64, len(first))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(count)
    heads = (np.cumsum(count) - count)[some]
    for bit in range(64 if len(some) else 0):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), heads)
        out[some] |= (2 * ones > count[some]).astype(np.uint64) << np.uint64(bit)
    return out


def marked(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) per row of ``df``."""
    words.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, text):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(doc_id).cast(pa.int64()),
                                              "fp": fingerprints(part.column(text), size).view(np.int64)})

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, fp long")


def _half(fp: Column, side: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if side else fp).bitwiseAND(F.lit(0xFFFFFFFF))


def _syndrome(half: Column) -> Column:
    """XOR of the numbers 1 to 31 of the set bits."""
    out = F.lit(0)
    for j in range(5):
        numbered = sum(1 << k for k in range(32) if k >> j & 1)
        out = out + F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(numbered))) % 2, j)
    return out.cast("int")


def _named(side: int, anchor: Column) -> Column:
    """One long for an anchor of the lower (0) or upper (1) half."""
    return anchor.bitwiseOR(F.lit(side << 32))


def homes(fp: Column) -> list[Column]:
    """The home anchor of each half."""
    out = []
    for side in (0, 1):
        half = _half(fp, side)
        out.append(_named(side, half.bitwiseXOR(_flip(_syndrome(half)))))
    return out


def _flip(number: Column) -> Column:
    """The bit with a number; none for 0."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), number).bitwiseAND(F.lit(0xFFFFFFFE))


def covering(marks: DataFrame) -> DataFrame:
    """key, fp: each fingerprint at all anchors within covering radius plus threshold of its halves."""
    return marks.select("fp", F.explode(F.concat(*[_anchors(F.col("fp"), side) for side in (0, 1)])).alias("key"))


def _anchors(fp: Column, side: int) -> Column:
    """The anchors within radius plus threshold of one half."""
    half = _half(fp, side)
    s = _syndrome(half)
    pairs = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: (i < i.bitwiseXOR(s)) | ((s == 0) & (i == 0)))
    near = F.transform(pairs, lambda i: half.bitwiseXOR(_flip(i)).bitwiseXOR(_flip(i.bitwiseXOR(s))))
    freed = half.bitwiseXOR(_flip(s)).bitwiseXOR(F.lit(1).cast("long"))
    return F.transform(F.concat(near, F.array(freed)), lambda c: _named(side, c))


def _apart(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _at_home(fp: str, key: str) -> Column:
    low, high = homes(F.col(fp))
    return F.when(F.col(key) < F.lit(1 << 32), low).otherwise(high) == F.col(key)


def _forest(home: np.ndarray, hc: np.ndarray, other: np.ndarray, oc: np.ndarray) -> list[tuple[int, int]]:
    """Links between components, as few as connect the same ones."""
    x, y = np.nonzero((np.bitwise_count(home[:, None] ^ other) <= DISTANCE) & (hc[:, None] != oc))
    _, at = np.unique(np.stack([hc[x], oc[y]]), axis=1, return_index=True)   # one link of two components is enough
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []
    for i, j in zip(x[at].tolist(), y[at].tolist(), strict=True):
        r, t = root(int(hc[i])), root(int(oc[j]))
        if r != t:
            parent[r] = t
            out.append((int(home[i]), int(other[j])))
    return out


def _crowded(placed: DataFrame) -> DataFrame:
    """Links (a, b) between components at anchors of many homes.

    ``placed``: key, fp, c (component), home.  Dealt anew by the bytes of the other half, then in
    pairs of a block of homes and a block of replicas."""
    other = F.when(F.col("key") < F.lit(1 << 32), _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    part = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(other, 8 * j).bitwiseAND(F.lit(255)).alias("byte"))
                               for j in range(4)]))
    by = ["key", "j", "byte"]
    dealt = placed.select("key", "fp", "c", "home", part.alias("p")).select("key", "fp", "c", "home", "p.j", "p.byte")
    sizes = dealt.groupBy(*by).agg(F.sum(F.col("home").cast("long")).alias("h"), F.count(F.lit(1)).alias("n"),
                                   F.min("c").alias("lo"), F.max("c").alias("hi")).where("h > 0 and lo < hi")
    dealt = shuffled(dealt).join(sizes.select(*by, F.ceil(F.col("h") / BLOCK).cast("int").alias("hb"),
                                              F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")), by)
    block = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    left = dealt.where("home").withColumn("x", block("hb")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    right = dealt.withColumn("y", block("nb")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)))
    cols = [*by, "x", "y", "fp", "c"]
    rows = left.select(*cols, F.lit(True).alias("home")).unionByName(right.select(*cols, F.lit(False).alias("home")))

    def links(table: pa.Table) -> pa.Table:
        fp, c, home = (np.asarray(table[n].combine_chunks()) for n in ("fp", "c", "home"))
        home = home.astype(bool)
        found = _forest(fp[home], c[home], fp[~home], c[~home])
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy(*by, "x", "y").applyInArrow(links, "a long, b long")


def linked(marks: DataFrame) -> DataFrame:
    """``a, b``: fingerprints of ``marks`` (fp, distinct) that differ in at most DISTANCE bits, enough
    of them to have the same components as all."""
    low, high = homes(F.col("fp"))
    held = marks.select("fp", F.explode(F.array(low, high)).alias("key"))
    heads = held.groupBy("key").agg(F.min_by("fp", F.xxhash64("fp", "key")).alias("head"), F.count(F.lit(1)).alias("homes"))
    # a replica matters if it is linked to the home drawn, or if that is not the only one
    met = shuffled(covering(marks)).join(heads, "key").where(
        (F.col("homes") > 1) | ((F.col("fp") != F.col("head")) & (_apart("fp", "head") <= DISTANCE)))
    met = materialize(met, "anchored")
    star = materialize(met.where((F.col("fp") != F.col("head")) & (_apart("fp", "head") <= DISTANCE)).select(
        F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")).distinct(), "star-links")
    joined = components(star)
    rest = met.where("homes > 1").join(shuffled(joined), F.col("fp") == F.col("node"), "left").select(
        "key", "fp", "homes", F.coalesce("component", "fp").alias("c"))
    rest = materialize(rest, "placed")
    # stored, so that the join meets plain shuffles, of which Spark splits a crowded anchor's
    mixed = materialize(rest.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), "mixed-keys")
    placed = materialize(rest.join(shuffled(mixed), "key").withColumn("home", _at_home("fp", "key")), "mixed-anchors")
    discard(met, rest, mixed)
    few = placed.where(F.col("homes") <= FEW)
    x = few.where("home").select("key", F.col("fp").alias("a"), F.col("c").alias("ca"))
    y = few.select("key", F.col("fp").alias("b"), F.col("c").alias("cb"))
    pairs = x.join(shuffled(y), "key").where((F.col("ca") != F.col("cb")) & (_apart("a", "b") <= DISTANCE)).select("a", "b")
    more = _crowded(placed.where(F.col("homes") > FEW))
    return star.unionByName(pairs).unionByName(more)


def simhash_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 lowercase hex digits), component_id (the
    smallest id reachable over links)."""
    signed = materialize(marked(df, doc_id, text, size), "fingerprints")
    named = signed.where("doc_id is not null")
    marks = materialize(named.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    links = linked(marks.select("fp"))
    # an id with several fingerprints is one document: they are linked
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).where("a <> hi").select("doc_id", "a")
    own = named.join(shuffled(several), "doc_id").where("fp <> a").select("a", F.col("fp").alias("b"))
    joined = components(links.unionByName(own))
    root = marks.join(shuffled(joined), F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = root.groupBy("c").agg(F.min("rep").alias("component_id"))
    roots = materialize(root.join(shuffled(least), "c").select(F.col("fp").alias("own"), "component_id"), "fingerprint-roots")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return signed.join(shuffled(roots), F.col("fp") == F.col("own"), "left").select(
        "doc_id", hexed, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
