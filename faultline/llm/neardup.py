"""MinHash near-duplicates by a signature-coordinate inverted join (op9).

A document's set is its distinct 5-word shingles (A-Z lower-cased; all words as one shingle
where there are fewer).  Documents of one set are one class, represented by the smallest id.
A class has ``COORDINATES`` MinHash values and is posted under each coordinate-value pair.

Links have a similarity of at least ``percent``.  Two such sets agree in at least ``matches``
coordinates but for a chance that the caller chooses with the two: 2e-7 at exactly 0.85 with 21
matches and at exactly 0.80 with 18, far less above.  So of a class's coordinate-value pairs,
ordered by how many classes share them, the first COORDINATES - matches + 1 must hold a common
one: pairs that nobody shares come first, post nothing and use up that prefix, and a class with
too few shared pairs is skipped.  Classes that meet in the prefix have all coordinates counted,
and what reaches ``matches`` is confirmed on the full sets.

A posting list is never expanded into all its pairs.  Each member first meets one member, drawn
by a hash anew in each list, and the confirmed links are contracted to components.  Lists that
still hold several components compare members of different ones: pair by pair in short lists
(at most FEW / 2 pairs a posting), block against block inside tasks in long ones, which return
a forest of the links found.  What is left out are pairs that are connected already, so
components are those of all links.

Defined results: null, empty and wordless texts have an empty set and are alone; rows of one
id are one document that has the links of all its rows, and a null id links with nothing; an
empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.components import components
from faultline.llm import words
from faultline.session import broadcast_if_small, materialize

SHINGLE = 5
COORDINATES = 40
#: Posting lists up to this length have their pairs compared one by one, longer ones in blocks.
FEW, BLOCK = 32, 512
#: Unless a caller says otherwise (op9), links have 100 * intersection >= PERCENT * union and MATCHES equal coordinates.
PERCENT, MATCHES = 85, 21
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(col: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, ascending, and the texts' offsets."""
    data, off = words.text_bytes(col)
    data = words.LOWER[data]
    mask = words.NOT_SPACE[data]
    starts, ends, at = words.spans(mask, off)
    codes, values = words.distinct(data, mask, starts, ends)
    word = words.hash_values(values)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(at)
    width = np.minimum(n, size)                       # words of a shingle; 0 without words
    count = np.where(n > 0, n - width + 1, 0)
    begin = words.ranges(at[:-1], count)
    wide = np.repeat(width, count)
    head = words.mix(np.arange(size + 1, dtype=np.uint64))
    total = np.full(len(wide), head[size])
    for k in range(size if len(wide) else 0):         # as if all shingles had all their words
        total = total * _FACTOR + word.take(begin + k, mode="clip")
    few = np.flatnonzero(wide < size)
    total[few] = head[wide[few]]
    for k in range(size if len(few) else 0):
        on = few[wide[few] > k]
        total[on] = total[on] * _FACTOR + word[begin[on] + k]
    total = words.mix(total)
    edge = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        total[a:b].sort()
    first = np.ones(len(total), bool)
    first[1:] = total[1:] != total[:-1]
    first[edge[:-1][count > 0]] = True
    return total[first], np.concatenate([[0], np.cumsum(first)])[edge]


def signatures(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, c1, c2 (128-bit name of the set), sig array<int> of COORDINATES values."""
    words.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, text):
            total, off = shingles(part.column(text))
            some = np.flatnonzero(np.diff(off))
            heads = off[some]
            name, sig = np.zeros((2, part.num_rows), np.uint64), np.zeros((part.num_rows, COORDINATES), np.int32)
            if len(some):
                for k in range(2):
                    name[k, some] = np.add.reduceat(words.mix(total + np.uint64(k + 1)), heads)
                base, key = total ^ (total >> np.uint64(29)), np.empty_like(total)
                for k in range(COORDINATES):
                    np.multiply(base, _odd(2 * k), out=key)
                    np.add(key, _odd(2 * k + 1), out=key)
                    least = np.minimum.reduceat(key, heads)
                    sig[some, k] = (words.mix(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * COORDINATES),
                                             pa.array(sig.ravel()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(doc_id).cast(pa.int64()), "n_shingles": pa.array(np.diff(off)),
                "c1": name[0].view(np.int64), "c2": name[1].view(np.int64), "sig": lists})

    return df.select(doc_id, text).mapInArrow(
        run, "doc_id long, n_shingles long, c1 long, c2 long, sig array<int>")


def _odd(k: int) -> np.uint64:
    return words.mix(np.array([k + 0x5851F42D4C957F2D], np.uint64))[0] | np.uint64(1)


def full_sets(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, c1, c2 and the whole set as array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, text):
            total, off = shingles(part.column(text))
            some = np.flatnonzero(np.diff(off))
            name = np.zeros((2, part.num_rows), np.uint64)
            for k in range(2 if len(some) else 0):
                name[k, some] = np.add.reduceat(words.mix(total + np.uint64(k + 1)), off[some])
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(doc_id).cast(pa.int64()), "c1": name[0].view(np.int64), "c2": name[1].view(np.int64),
                "members": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(total.view(np.int64)))})

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, c1 long, c2 long, members array<long>")


def prefix_postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """rep, key, n: the postings of each class that any of its links must share one of.

    ``classes``: rep, n, sig."""
    posts = classes.select("rep", "n", F.posexplode("sig").alias("k", "v")).select(
        "rep", "n", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long")).alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = posts.join(shared, "key")
    by = Window.partitionBy("rep")
    ranked = common.withColumn("held", F.count(F.lit(1)).over(by)).where(F.col("held") >= matches).withColumn(
        "rank", F.row_number().over(by.orderBy("df", "key")))
    return ranked.where(F.col("rank") <= F.col("held") - matches + 1).select("rep", "key", "n")


def _close(n: str, m: str, percent: int):
    """Sizes of sets that can be linked."""
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))


def _matching(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs whose signatures agree in enough coordinates."""
    left = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(left, "a").join(right, "b").where(same >= matches).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are links by their full sets."""
    left = sets.select(F.col("rep").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("rep").alias("b"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    held = pairs.join(left, "a").withColumn("na", F.size("ma")).join(right, "b")
    return held.withColumn("both", both).where(
        F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.size("mb") - F.col("both"))).select("a", "b")


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between components among the members of a list's blocks i and j; a forest of them.

    A pair counts in the first list that both are in, and, in a list, in the block pair of its
    own blocks.  Overlaps of all pairs at once are products of 0/1 matrices."""
    rep, c, n, block, i, j, key = (np.asarray(table[x].combine_chunks()) for x in ("rep", "c", "n", "block", "i", "j", "key"))
    todo = (c[:, None] < c) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
    if i[0] != j[0]:
        todo &= block[:, None] != block
    earlier = _overlaps(table["lists"].combine_chunks(), lambda v: v < key[0])
    todo &= earlier == 0
    some = np.flatnonzero(todo.any(axis=0) | todo.any(axis=1))
    found = []
    if len(some):
        both = _overlaps(table["members"].combine_chunks().take(pa.array(some)))
        todo, n, c, rep = todo[np.ix_(some, some)], n[some], c[some], rep[some]
        x, y = np.nonzero(todo & (100 * both >= percent * (n[:, None] + n - both)))
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            r, t = root(int(c[p])), root(int(c[q]))
            if r != t:
                parent[r] = t
                found.append((int(rep[p]), int(rep[q])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _overlaps(lists: pa.Array, keep=None) -> np.ndarray:
    """Number of common values of each two lists (of distinct values)."""
    values, own = np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    if keep is not None:
        values, own = values[keep(values)], own[keep(values)]
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, own = (np.cumsum(count > 1) - 1)[column[shared]], own[shared]
    total = np.zeros((len(lists), len(lists)), np.float32)
    order = np.argsort(column, kind="stable")
    column, own = column[order], own[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        at = slice(*np.searchsorted(column, [lo, lo + width]))
        part = np.zeros((len(lists), width), np.float32)
        part[own[at], column[at] - lo] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _long_lists(placed: DataFrame, posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components in long lists, block by block.

    A list of s members is cut into s / BLOCK blocks, and each pair of blocks is compared in one
    task step of at most about 2 * BLOCK members, which returns links only, never pairs."""
    own = posts.join(placed.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.collect_list("key").alias("lists"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = placed.join(own, "rep").join(sets, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn(
        "o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep", "c", "n",
                       "lists", "members")

    def links(table: pa.Table) -> pa.Table:
        return _block_links(table, percent)

    return rows.groupBy("key", "i", "j").applyInArrow(links, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    matches: int = MATCHES) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept."""
    signed = materialize(signatures(df, doc_id, text), "signatures")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    groups = materialize(named.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "set-classes")
    classes = materialize(named.join(groups, ["c1", "c2"]).where("doc_id = rep").dropDuplicates(["c1", "c2"]).select(
        "rep", "c1", "c2", F.col("n_shingles").alias("n"), "sig"), "classes")
    posts = materialize(prefix_postings(classes, matches), "postings")

    # each member of a posting list meets one member, another one in each list
    by = F.xxhash64("rep", "key")
    heads = posts.groupBy("key").agg(F.min(F.struct(by.alias("h"), "rep", "n")).alias("head"),
                                     F.count(F.lit(1)).alias("size")).where("size > 1")
    star = posts.join(heads, "key").where((F.col("rep") != F.col("head.rep")) & _close("n", "head.n", percent)).select(
        F.least("rep", "head.rep").alias("a"), F.greatest("rep", "head.rep").alias("b")).distinct()
    star = materialize(_matching(star, classes, matches), "star-pairs")

    # full sets of all classes that a link can have
    wanted = posts.join(heads.select("key"), "key", "left_semi").select("rep").distinct()
    wanted = classes.join(wanted, "rep", "left_semi").select("rep", "c1", "c2")
    sets = df.join(wanted.select(F.col("rep").alias("__rep")).distinct(), F.col(doc_id) == F.col("__rep"), "left_semi")
    sets = full_sets(sets, doc_id, text).withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "c1", "c2"], "left_semi")
    sets = materialize(sets.dropDuplicates(["c1", "c2"]).select("rep", "members"), "sets")
    # an id with several sets is one document: its classes are linked
    several = named.groupBy("doc_id").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).where("lo <> hi")
    own = named.join(several.select("doc_id"), "doc_id", "left_semi").join(groups, ["c1", "c2"]).select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = materialize(_confirmed(star, sets, percent).unionByName(own), "links")
    joined = materialize(components(links), "near-components")

    # lists that still hold several components: members of different ones meet
    placed = posts.join(joined, posts["rep"] == joined["node"], "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where(
        "lo < hi").select("key", "size")
    placed = materialize(placed.join(mixed, "key"), "mixed-lists")
    few = placed.where(F.col("size") <= FEW)
    x, y = few.alias("x"), few.alias("y")
    rest = x.join(y, F.col("x.key") == F.col("y.key")).where(
        (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")) & _close("x.n", "y.n", percent)).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = _confirmed(_matching(rest, classes, matches), sets, percent).unionByName(
        _long_lists(placed.where(F.col("size") > FEW), posts, sets, percent))
    more = materialize(more, "more-links")
    if more.take(1):
        joined = materialize(components(more.unionByName(
            joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))), "near-components")

    reps = signed.join(groups, ["c1", "c2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    found = reps.join(joined, reps["rep"] == joined["node"], "left")
    root = F.coalesce("component", "rep", "doc_id")
    return found.select("doc_id", "n_shingles", root.alias("component_id"),
                        F.col("doc_id").eqNullSafe(root).alias("kept"))


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
                     matches: int = MATCHES) -> DataFrame:
    """``df`` without the documents that are linked, over any path, to one with a smaller id."""
    (id_,) = words.unused(df, "gone_id")
    gone = near_duplicates(df, doc_id, text, percent, matches).where("not kept").select(F.col("doc_id").alias(id_)).distinct()
    return df.join(broadcast_if_small(materialize(gone, "near-copies")), F.col(doc_id) == F.col(id_), "left_anti")
